import hashlib
import random
import re

from oeeforge.llm import pii_bootstrap as p

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    spans = [(m.start(), n, m.end(), kind) for n, (kind, x) in enumerate(PATTERNS.items()) for m in re.finditer(x, text) if good(kind, m.group())]
    return ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in sorted(spans))


def strings(found):
    names = [*p.BASE, p.ADDED]
    write = lambda spans: ",".join(f"{names[s.kind]}:{s.start}:{s.end}" for s in spans)
    return [(r.doc_id, write(r.base), write(r.added)) for r in found.collect()]


def test_base_equals_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["a.b@c.de", "x@y", "@", "é@a.b.c", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "79927398713", "12", "+1 (202) 555-0175",
             "+44 20 7946 0958.", "+1 ", "-", " ", "  ", ".", "𐍈", "word", "a@b.c%d@e.f", "+", "0000000000000000", "\n", "()", "%"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["", None, "1" * 50_000, "a" * 50_000 + "@b.c", ("x" * 3000 + " ") * 20, "+1" + " " * 20_000, "1.2.3.4 " * 3000, "a@b" + ".c" * 20_000, "-" * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    got = {i: b for i, b, _ in strings(p.find(docs))}
    for i, t in enumerate(texts):
        assert got[i] == base(t or ""), (t or "")[:200]


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"Please write, the member card no {card} is mine; text {i}.", 1)
            for i, card in enumerate(["4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004", "4012888888881881", "4222222222222"])]
    rows += [(50, "Hello, the member card no ZX-99812 is mine.", 1), (51, "elsewhere one reads ZX-99812 again", 1), (52, "The year 1999 was good", 1), (None, "member card no 7712-K is mine", 1), (53, None, 1), (54, "", 1)]
    rows += [(60 + i, f"chapter page nr {i}34 of book", 1) for i in range(20)] + [(90, "page nr 4111111111111111 of", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = {i: (b, a) for i, b, a in strings(p.find(docs))}
    text = dict((i, t) for i, t, _ in rows)
    at = text[50].index("ZX-99812")
    assert got[50] == ("", f"id:{at}:{at + 8}")
    at = text[51].index("ZX-99812")
    assert got[51] == ("", f"id:{at}:{at + 8}")
    assert got[None][1] == "id:15:21"
    assert got[52] == ("", "") and got[53] == ("", "") and got[54] == ("", "")
    assert all(got[60 + i] == ("", "") for i in range(20)) and got[0][0].startswith("card:")


def test_discovered_instances_support_patterns_of_their_own(spark):
    cards = ["4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004", "4012888888881881", "4222222222222", "5105105105105100"]
    found = [f"ZX-9981{k}" for k in range(6)]
    rows = [(k, f"Please write, the member card no {x} is mine") for k, x in enumerate(cards + found)]
    rows += [(50 + k, f"then our locker key {x} was lost") for k, x in enumerate([*found, "QY-5512"])]
    rows += [(80 + k, f"on some other day {k}934 came by") for k in range(9)]
    text = dict(rows)
    got = {i: a for i, _, a in strings(p.find(spark.createDataFrame(rows, "doc_id long, text string")))}
    at = text[56].index("QY-5512")
    assert got[56] == f"id:{at}:{at + 7}"
    assert all(got[50 + k] for k in range(6)) and not any(got[80 + k] for k in range(9))


def test_base_spans_without_digits_are_seeds(spark):
    mails = ["alice.smith@example.com", "bob@example.org", "carol_j@mail.example", "dave@example.net", "erin@example.com", "frank@example.org"]
    rows = [(k, f"you can reach me under {x} all day") for k, x in enumerate(mails)] + [(20, "you can reach me under grace77 all day")]
    rows += [(30, "you can reach me under heidi@example.com.")]
    got = {i: (b, a) for i, b, a in strings(p.find(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[20] == ("", "id:23:30")
    assert all(got[k] == (f"email:23:{23 + len(x)}", "") for k, x in enumerate(mails)) and got[30][1] == ""


def test_equal_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a@b.cd", "x"), (1, "a@b.cd", "y"), (None, None, "z")], "doc_id long, text string, base string")
    assert sorted(strings(p.find(docs)), key=str) == sorted([(1, "email:0:6", ""), (1, "email:0:6", ""), (None, "", "")], key=str)
    assert p.find(docs.limit(0)).count() == 0


def test_query_columns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = p.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        own = base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest() and (r.n_added or r.spans == own)
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in own.split(",") if x])
