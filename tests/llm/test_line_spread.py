from collections import defaultdict

from oeeforge.llm import line_spread

HEAD = "shared header line of all sites"
SCHEMA = "doc_id long, text string, source string, n_chars int, line_hash string, pos int"


def brute(rows, min_sites, min_chars=20):
    site_of = {}
    for _, text, source, *_ in rows:
        own = "" if source is None else f"s{source}"
        site_of[text or ""] = min(own, site_of.get(text or "", own))
    sites = defaultdict(set)
    for text, site in site_of.items():
        for line in text.split("\n"):
            if len(line.strip(" ")) >= min_chars:
                sites[line.strip(" ")].add(site)
    wide = {line for line, s in sites.items() if len(s) >= min_sites}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        hit = [x.strip(" ") in wide for x in lines]
        out.append((doc_id, "\n".join(x for x, h in zip(lines, hit) if not h) if any(hit) else text, len(lines), sum(hit)))
    return out


def test_spread_lines_go_and_the_rest_stays(spark):
    rows = [(i, f"{HEAD}\n{"own words " * 9} of document number {i} and many more than in the header\n  {HEAD} ", f"s{i % 6}", 0, "x", 1) for i in range(12)]
    rows += [(100, HEAD, "s1", 31, "x", 1), (None, f"{HEAD}\n" + "null id text " * 5, "s2", 0, None, 1), (None, f"{HEAD}\n" + "null id text " * 5, "s2", 0, None, 1)]
    rows += [(101, None, "s3", None, "x", 1), (102, "", None, 0, "x", 1), (103, f"{HEAD}\n" + "word " * 40_000, None, 0, "x", 1)]
    rows += [(200 + i, "a line on three sites only, no more\n" + "something else that is long enough here", f"s{i % 3}", 0, "x", 1) for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for min_sites in (4, 6, 7, 8):
        got = [(r.doc_id, r.text, r.lines_total, r.lines_removed) for r in line_spread.remove_spread_lines(docs, min_sites=min_sites).collect()]
        assert sorted(got, key=str) == sorted(brute(rows, min_sites), key=str)
    out = line_spread.remove_spread_lines(docs, min_sites=4)
    assert out.columns[:6] == docs.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[0].n_chars == len(kept[0].text) and kept[100].text == "" and kept[101].text is None


def test_many_sites_are_counted_as_exactly_as_few(spark):
    rows = [(i, f"line seen on {n} sites in all, no less\nbody {i} {n} " + "of its own words " * 4, f"s{i}", 0, "x", 1) for n in (30, 36, 39, 40, 41, 44, 60) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.text, r.lines_total, r.lines_removed) for r in line_spread.remove_spread_lines(docs, min_sites=40).collect()]
    assert sorted(got) == sorted(brute(rows, 40))


def test_empty_table(spark):
    assert line_spread.remove_spread_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_of_mostly_boilerplate_lose_it_and_copied_texts_stay(spark):
    foot = "a footer line that all of the sites have\nand one more line that they all have"
    rows = [(i, f"{foot}\nown {i}", f"s{i}", 0, "x", 1) for i in range(9)]
    rows += [(100 + i, "a whole document that was copied\nfrom one site to all of the others", f"s{i}", 0, "x", 1) for i in range(9)]
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_spread.remove_spread_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: (f"own {r[0]}", 2) if r[0] < 100 else (r[1], 0) for r in rows}


def test_columns_of_any_name_pass_through(spark):
    names = ["doc_id", "text", "source", "gone", "_gone", "_size", "_doc_id", "lines_total", "LINES_removed", "row", "key", "whole", "hit_id", "a.b", "n_chars"]
    rows = [(i, f"{HEAD}\nown {i}", f"s{i}", *"abcdefghijk", 7) for i in range(9)]
    schema = ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'int' if c == 'n_chars' else 'string'}" for c in names)
    out = line_spread.remove_spread_lines(spark.createDataFrame(rows, schema))
    assert out.columns == [*names, "lines_total_", "lines_removed_"]
    assert sorted(map(tuple, out.collect())) == [(i, f"own {i}", f"s{i}", *"abcdefghijk", 5, 2, 1) for i in range(9)]
