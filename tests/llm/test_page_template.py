from oeeforge.llm import page_template as t


def text(spark, pages):
    table = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    return [(r.page_id, r.url, r.text) for r in t.extract(table).collect()]


def page(title, body, extra=""):
    return (f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p><p>x</p>";</script></head><body>'
            f'<header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>{body}'
            f'<aside>More</aside><form><input name=q><button>Go</button></form>{extra}<footer>&copy; site &middot; legal</footer></body></html>')


def test_article_blocks_and_character_references(spark):
    body = "<article><h1>Big &amp; small</h1><p>First&nbsp; line\n of <b>bold</b>&#33;<br>next<p>Second<ul><li>One<li>Two</ul><div class='comments'><p>me too</div><script>1</script></article>"
    got = text(spark, [(1, "http://a.example/x", page("T", body), "h")])
    assert got == [(1, "http://a.example/x", "Big & small\n\nFirst line of bold! next\n\nSecond\n\nOne\n\nTwo")]


def test_hosts_without_article_markup_use_the_deduced_slot(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    pages, want = [], {}
    for i in range(40):
        paragraphs = [" ".join(words[(i * k + j) % 10] for j in range(12)) + f" number {i} {k}." for k in range(1, 4)]
        inner = "".join(f"<p>{p}</p>" for p in paragraphs)
        pages.append((i, f"https://user@WWW.b.example:80/{i}", page(f"T{i}", f"<div class='top x{i}'>Welcome to all of us here</div><div class='c{i}'><p>Read this first, always the same.</p>{inner}</div>"), None))
        want[i] = "\n\n".join(paragraphs)
    assert {i: x for i, _, x in text(spark, pages)} == want


def test_copies_on_a_host_are_no_template(spark):
    same = page("T", "<article><h1>Copied</h1><p>The same article on several pages.</p></article>")
    other = [page("T", f"<article><h1>H{i}</h1><p>Own text {i}.</p></article>") for i in range(30)]
    got = text(spark, [(i, "http://c.example/", x, None) for i, x in enumerate([same] * 12 + other)])
    assert {x for i, _, x in got if i < 12} == {"Copied\n\nThe same article on several pages."}
    assert sorted(x for i, _, x in got if i >= 12) == sorted(f"H{i}\n\nOwn text {i}." for i in range(30))


def test_a_hosts_slot_is_found_without_its_paths(spark):
    import random

    rng = random.Random(4)
    hosts = {"zero": {"/html/body/div": 0}, "bare": {"": 7}}
    for k in range(60):
        paths = {""} if k % 7 == 0 else set()
        for _ in range(rng.randint(1, 25)):
            paths.add("/html/body" + "".join("/" + rng.choice(["div", "div.a", "section", "td", *(["article", "div.story", "main"] if k % 3 == 0 else [])]) for _ in range(rng.randint(0, 6))))
        hosts[f"h{k}"] = {p: rng.randint(0, 10**9) for p in sorted(paths)}
    sizes = spark.createDataFrame([(h, p, n) for h, x in hosts.items() for p, n in x.items()], "host string, path string, size long")
    assert {r.host: r.slot for r in t.main_slots(sizes).collect()} == {h: t.main_path(x) for h, x in hosts.items()}
    pages = [("h", i, f'<html><body><div id="slug-{"x" * (i % 50)}{chr(97 + i % 26)}"><p>text {i} of this page</p></div></body></html>') for i in range(500)]
    own = t.templates(spark.createDataFrame(pages, "host string, page_key long, html string")).collect()
    assert len(own) == 1 and len(str(own[0])) < 1000


def test_only_ordered_and_nested_classes_of_distinct_pages_are_template(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    own = lambda i, k: " ".join(words[(i * k + j) % 10] for j in range(20)) + f" number {i} {k}."
    shell = lambda inner: f"<html><body><div class='box'>{inner}</div></body></html>"
    copy = shell("<p>Copied first.</p><p>Copied second.</p><p>Copied third.</p>")
    pages = [(i, "http://copies.example/", copy, None) for i in range(12)] + [(12 + i, "http://copies.example/", shell(f"<p>{own(i, 3)}</p>"), None) for i in range(2)]
    want = {**{i: "Copied first.\n\nCopied second.\n\nCopied third." for i in range(12)}, **{12 + i: own(i, 3) for i in range(2)}}
    for i in range(12):  # a heading in every article stays, a paragraph in every one does not
        pages.append((100 + i, "http://headings.example/", shell(f"<p>{own(i, 3)}</p><h2>Summary</h2><p>{own(i, 7)}</p><p>Always the same.</p>"), None))
        want[100 + i] = f"{own(i, 3)}\n\nSummary\n\n{own(i, 7)}"
    for i in range(20):  # two kinds of pages, each with a list of its own
        links = "<ul><li>Alps</li><li>Lakes</li></ul>" if i < 8 else "<dl><dt>Rail</dt><dd>Road</dd></dl>"
        pages.append((200 + i, "http://kinds.example/", shell(f"{links}<p>{own(i, 3)}</p><p>{own(i, 7)}</p>"), None))
        want[200 + i] = f"{own(i, 3)}\n\n{own(i, 7)}"
    said = ["Winds are light.", "Rain comes late.", "Nights stay cool."]
    for i in range(12):  # on every page, but in no order
        turn = [said[(i + j) % 3] for j in range(3)]
        pages.append((300 + i, "http://order.example/", shell("".join(f"<blockquote>{x}</blockquote>" for x in turn) + f"<p>{own(i, 3)}</p>"), None))
        want[300 + i] = "\n\n".join([*turn, own(i, 3)])
    assert {i: x for i, _, x in text(spark, pages)} == want


def test_classes_out_of_order_or_crossing_are_broken():
    order = {t: (k, i) for k, c in enumerate([[1, 2, 3], [10, 11, 12], [20, 21]]) for i, t in enumerate(c)}
    check = lambda tokens: t.broken_classes(tokens, order, [3, 3, 2])
    assert check([1, 10, 11, 12, 2, 20, 21, 20, 21, 3]) == ({0, 1, 2}, set())
    assert check([1, 5, 2, 3, 1, 2, 3]) == ({0}, set())
    assert check([1, 3, 2]) == ({0}, {0})
    assert check([1, 10, 2, 11, 12, 3]) == ({0, 1}, {1})
    assert check([10, 1, 11, 12, 2, 3]) == ({0, 1}, {1})
    assert check([20, 10, 11, 21, 12]) == ({1, 2}, {2})
    assert check([1, 2]) == ({0}, {0})


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>{'word ' * 50}{i}</p>" for i in range(3000))
    pages = [(1, None, None, "x"), (None, None, "", "x"), (2, "no url", "plain text only", "x"), (3, "http://d.example", long, "x"), (3, "http://d.example", long, "x"),
             (4, "http://e.example", "<p>a < b and <unclosed", "x"), (5, "http://f.example", "</div></p><article><p>x</article></article><p>after", "x"),
             (6, "http://g.example", "<article><p>one<p>two<script>var x = '<p>no</p>'", "x")]
    got = sorted(text(spark, pages), key=str)
    by = {i: x for i, _, x in got}
    assert len(got) == len(pages) and by[1] == "" and by[None] == "" and by[2] == "plain text only" and by[5] == "x" and by[6] == "one\n\ntwo"
    assert by[3].count("\n\n") == 2999 and "a < b and" in by[4]
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert t.extract(table).count() == 0


def test_query_covers_the_table(spark):
    import re
    from html import unescape

    rows = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = t.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", rows[r.page_id], re.S).group(1)
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
