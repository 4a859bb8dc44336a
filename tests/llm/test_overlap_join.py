import random
import re

import numpy as np
import pytest

from oeeforge.llm import overlap_join as j


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    own = [(i, shingles(t)) for i, t in rows]
    ids = [i for i, s in own if i is not None]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, s) for i, s in own if i is not None and s]
    for x, (i, a) in enumerate(known):
        for k, b in known[x + 1 :]:
            if 100 * len(a & b) >= 75 * len(a | b):
                r, q = root(i), root(k)
                parent[max(r, q)] = min(r, q)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in own), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    common_passage = " ".join(word() for _ in range(25))
    bases = [" ".join(word() for _ in range(rng.randint(3, 80))) for _ in range(max(2, n // 12))]
    rows = []
    for i in range(n):
        words = rng.choice(bases).split() if rng.random() < 0.8 else [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, max(1, len(words) // 12))):
            if words:
                words[rng.randrange(len(words))] = word()
        if rng.random() < 0.2:
            words = words[: rng.randint(0, len(words))]
        text = rng.choice([" ", "\n", "\t ", "  "]).join(words)
        if rng.random() < 0.3:
            text = f"{text} {common_passage}" if rng.random() < 0.5 else f"{common_passage} {text}"
        rows.append((i * 3 + 5, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("seed,n,frequent,rounds,tile", [(1, 160, 64, 2, 1024), (2, 300, 8, 2, 1024), (3, 200, 64, 0, 4), (4, 200, 8, 3, 7)])
def test_components_equal_brute_force(spark, monkeypatch, seed, n, frequent, rounds, tile):
    monkeypatch.setattr(j, "FREQUENT", frequent)
    monkeypatch.setattr(j, "ROUNDS", rounds)
    monkeypatch.setattr(j, "TILE", tile)
    rows = corpus(seed, n)
    got = j.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_near_copies_whose_centre_is_no_partner_of_all(spark):
    words = [f"w{i}" for i in range(100)]
    chain = []  # each is a neighbour of the next, not of the ones further on
    for k in range(12):
        chain.append((k, " ".join(words[5 * k :] + [f"x{i}" for i in range(5 * k)])))
    assert sorted(map(tuple, j.join(spark.createDataFrame(chain, "doc_id long, text string")).collect()), key=str) == brute(chain)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (None, "one two"), (7, "é é é é é é é"), (7, "é é é é é é é"),
            (8, "word " * 30_000), (9, "word " * 4), (10, "word " * 5), (-11, "one two"), (12, "a b c d e f g h"), (12, "q r s t u v w x"), (13, "q r s t u v w x")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = sorted(map(tuple, j.join(docs).collect()), key=str)
    want = {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, -11), (5, 1, -11), (6, 1, 6), (None, 1, None), (7, 1, 7), (8, 1, 8), (9, 1, 9), (10, 1, 8), (-11, 1, -11), (12, 4, 12), (13, 4, 12)}
    assert set(got) == want and len(got) == len(rows)
    assert j.join(docs.limit(0)).count() == 0


def test_short_lists_leave_out_t_minus_one():
    rng = np.random.default_rng(0)
    bits = np.zeros(j.BITS, bool)
    bits[rng.integers(0, j.BITS, j.BITS // 2)] = True
    for n in (1, 2, 3, 4, 5, 7, 100):
        members = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        short = j.short_lists(members, bits)
        assert len(short) == len(members) - (3 * len(members) + 3) // 4 + 1 and len(set(short.tolist())) == len(short)


def test_possible_never_drops_a_link():
    rng = np.random.default_rng(5)
    bits = np.zeros(j.BITS, bool)
    bits[rng.integers(0, j.BITS, j.BITS // 3)] = True
    dropped = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([0.5, 0.8, 0.9, 1.0])]
        b = np.unique(np.concatenate((keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 3))).astype(np.uint64))))
        if not len(b):
            continue
        short = []
        for s in (a, b):
            x = j.short_lists(s, bits)
            short.append(((x >> np.uint64(33)) | (bits[x.view(np.int64) % j.BITS].astype(np.uint64) << np.uint64(31))).astype("<u4"))
        linked = j.links(len(a), len(b), len(np.intersect1d(a, b)))
        ok = j.possible(len(a), short[0], len(b), short[1])
        assert ok or not linked
        dropped += not ok
    assert dropped > 300


def test_bins_never_drop_a_link():
    rng = np.random.default_rng(6)
    dropped = 0
    for _ in range(2000):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        keep = a[rng.random(len(a)) < rng.choice([0.2, 0.8, 0.9, 1.0])]
        b = np.unique(np.concatenate((keep, rng.integers(0, 2**63, int(rng.integers(1, 2 + n // 3))).astype(np.uint64))))
        ok = j.reachable(np.array([len(a)]), j.sketch(a)[None], np.array([len(b)]), j.sketch(b)[None])[0, 0]
        assert ok or not j.links(len(a), len(b), len(np.intersect1d(a, b)))
        dropped += not ok
    assert dropped > 300


def test_a_group_of_near_copies_costs_pairs_in_proportion(spark, monkeypatch):
    made = {}

    def counted(pairs, own, stage, f=j.verify):
        pairs = j.common.stage_table(pairs, "counted")
        made[key] = made.get(key, 0) + pairs.count()
        return f(pairs, own, stage)

    monkeypatch.setattr(j, "verify", counted)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(400):  # copies of one text with one to three words changed: those with three do not link with each other
        words = list(base)
        for _ in range(1 + k % 3):
            words[rng.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(words)))
    for key in (200, 400):
        assert {r.component_id for r in j.join(spark.createDataFrame(rows[:key], "doc_id long, text string")).collect()} == {0}
    assert made[200] < 20 * 200 and made[400] < 20 * 400, made  # of 19,900 and 79,800 pairs


def test_a_doc_id_with_two_texts_does_not_join_them(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    got = j.join(spark.createDataFrame([(12, a), (12, b), (5, a), (13, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (12, 5), (12, 12), (13, 12)]
