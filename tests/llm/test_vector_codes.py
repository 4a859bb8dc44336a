import hashlib

import numpy as np
import pytest

from oeeforge.llm import vector_codes as c
from oeeforge.llm import vectors

from vector_tables import clustered, frame, odd_rows, whole


def nearest(x, book):
    return min(((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book)), default=None)


def brute(rows, dim=64, parts=4, entries=256, rounds=4):
    kept = sorted(((i, whole(v, dim), k) for i, v, k in rows if whole(v, dim) is not None), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = dim // parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(part(v, p), books[p])[1], []).append(part(v, p))
            for e, m in members.items():
                books[p][e] = [sum(col) // len(m) for col in zip(*m)]
    out = []
    for i, v, k in kept:
        found = [nearest(part(v, p), books[p]) for p in range(parts)]
        out.append((i, k, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    by_label = {}
    for _, k, _, e in out:
        by_label[k] = by_label.get(k, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, e, by_label[k], digest) for i, k, code, e in out), key=str)


@pytest.mark.parametrize("kind", ["clustered", "coarse", "equal", "few"])
def test_gnat_finds_the_first_nearest_entry(kind):
    rng = np.random.default_rng(4)
    entries = {
        "clustered": np.floor(1024 * clustered(1, 256, 16)).astype(np.int64),
        "coarse": rng.integers(-2, 3, (256, 3)),  # many ties and equal entries
        "equal": np.zeros((256, 5), np.int64),
        "few": rng.integers(-9, 9, (3, 4)),
    }[kind]
    queries = np.concatenate((entries, rng.integers(-3, 4, (700, entries.shape[1])) * (200 if kind == "clustered" else 1)))
    tree = c.Gnat(entries)
    index, squared = tree.nearest(queries)
    all_ = ((queries[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == all_.argmin(1)).all() and (squared == all_.min(1)).all()
    if kind == "clustered":
        assert tree.compared < 0.8 * all_.size  # subtrees were skipped


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(5)
    entries = rng.integers(-(1 << 26), 1 << 26, (60, 16))
    entries[1] = entries[0] + 1
    queries = np.concatenate((entries, entries + rng.integers(-1, 2, entries.shape)))
    index, squared = c.Gnat(entries).nearest(queries)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(q, e)), i) for i, e in enumerate(entries)) for q in queries]
    assert list(zip(squared.tolist(), index.tolist())) == want
    assert (vectors.squares(queries, entries)[0] >= 0).all()


def test_codes_equal_brute_force(spark):
    x = clustered(2, 330)
    rows = [(int(7 * i % 331), v.tolist(), None if i % 9 == 0 else i % 3) for i, v in enumerate(x)]
    rows += [(1000, x[0].tolist(), 0), (1000, x[0].tolist(), 0), (1000, x[1].tolist(), 1), (None, x[2].tolist(), 2), (7, x[3].tolist(), 1), *odd_rows(), (999, [0.1] * 63, 1)]
    got = c.compress(frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_few_rows_and_decoding(spark):
    rows = [(i, [i / 8, -i / 4, 0.25, 0.0003], i % 2) for i in range(10)]
    kept = vectors.whole_numbers(frame(spark, rows), 4, "vec_id", "label")
    books = c.fit(kept, 2, 256)
    coded = c.decode(c.encode(kept, books), books)
    assert {r["vec_id"]: (r["vector"], r["error"]) for r in coded.collect()} == {i: (whole(v, 4), 0) for i, v, _ in rows}
    assert c.compress(frame(spark, odd_rows())).count() == 0
    assert c.compress(frame(spark, rows).limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
