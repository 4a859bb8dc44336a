"""Operator 2: main text of web pages, without the template that each host's pages share, by equivalence classes of tokens.

1. Every distinct page of a host is read as tokens: the tags of blocks and containers, and the text runs, each in its role (the path
   of its enclosing containers). A token's occurrence vector, how often it is on each page, is kept as sums of hashes, which
   build up on the map side, so a host with a third of all pages is no group of rows anywhere.
2. Tokens of one occurrence vector are an equivalence class. Classes of at least ``MIN_TOKENS`` tokens on at least ``MIN_PAGES`` distinct
   pages and ``MIN_SHARE`` of the host's are held against the pages again: a class is kept if its tokens come in one order on all of
   its pages, if it crosses no class of more pages (each lies between two tokens of the other, or beside it), and if its
   pages hold at least as much text outside of all classes as it has itself (near copies of one article do not). The text
   runs of the classes kept are the host's template. Of the text left, the container that holds most of it, with the
   article or main element preferred, is the slot of the host's articles.
3. Every page gives the blocks of that slot, without text runs of the template (but with headings that text of the page follows)
   and without parts whose element, role, class or id says menu, header, footer, sidebar, notice, advert, form or comments. A page
   without its host's slot, or of a host with few pages, falls back to its own largest slot.

No token is on ``MIN_SHARE`` of a host's pages unless it is among the tokens of that many, so a host's classes hold at most 1 / ``MIN_SHARE``
times the tokens of its average page: that is what a page is sent.

Defined cases: null html is empty and has an empty text; pages without url share one host; broken markup (missing ends,
stray ends, text after the end) is read as browsers do in the common cases. Rows stay one to one, with repeats, equal ids
and nulls; equal pages get equal texts. Empty tables give empty results. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common

#: A class of tokens is large and frequent from this many tokens, distinct pages and share of the host's distinct pages on.
MIN_TOKENS = 3
MIN_PAGES = 5
MIN_SHARE = 0.05

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*+>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("html body article main section div nav header footer aside form menu dialog ul ol dl table tbody thead tfoot tr td th figure details fieldset center blockquote".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption summary hgroup legend hr".split())
_OUT = frozenset("head nav footer aside form menu dialog button noscript label input legend fieldset".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog search menu menubar form alert".split())
#: Words in a class or id that name something beside the article.
_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav|navbar|navigation|"
    r"menu\w*|breadcrumb\w*|sidebar\w*|side|widget\w*|footer\w*|foot|header|masthead|topbar|toolbar|comment\w*|disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|"
    r"pagination|pager|search|skip|copyright|legal|disclaimer)(?:$|[\s_-]|\d)", re.I)
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|story|content|main|maintext|body-?text|prose)(?:$|[\s_-]|\d)", re.I)
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("path", "out", "text", "heading")

    def __init__(self, path: str, out: bool, text: str, heading: bool):
        self.path, self.out, self.text, self.heading = path, out, text, heading


def read_blocks(page: str, marks: list[tuple[str, str, int]] | None = None) -> list[Block]:
    """The text blocks of a page in page order, each with the path of its containers. ``marks`` gets the page's tokens as (path, value,
    characters): text runs, and tags (without characters) that begin a block or end a container, all outside of parts left out."""
    blocks: list[Block] = []
    # open elements: name, path of containers, is it out of the article, is it a header
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
    run: list[str] = []

    def flush() -> None:
        if run:
            text = "".join(run)
            run.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                _, path, out, header = stack[-1]
                heading = any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-4:])
                blocks.append(Block(path, out or (header and not (heading and ("/article" in path or "/main" in path))), text, heading))
                if marks is not None and not blocks[-1].out:
                    marks.append((path, text, len(text)))

    def end(upto: int) -> None:
        if marks is not None:
            marks.extend((path, f"</{name}", 0) for name, path, out, header in reversed(stack[upto:]) if name in _CONTAINERS and not (out or header))
        del stack[upto:]

    def close(upto: int) -> None:
        if any(s[0] in _BLOCKS for s in stack[upto:]):
            flush()
        end(upto)

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            run.append(" " if m["raw"] else "")
            continue
        if m["end"]:
            found = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if found and not (name not in _CONTAINERS and any(s[0] in _CONTAINERS for s in stack[found + 1 :])):
                close(found)
            elif name in _BLOCKS:
                flush()
            continue
        if name in _BLOCKS:
            flush()
            # a paragraph ends where a block begins; a list item, row or cell where the next one begins
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ()) + (
                "p", "h1", "h2", "h3", "h4", "h5", "h6")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    end(k)
                    break
                if stack[k][0] in _CONTAINERS:
                    break
        elif name == "br":
            run.append(" ")
        if name in _VOID or m["rest"].endswith("/"):
            if name not in _BLOCKS:
                run.append(" " if name in ("br", "img") else "")
            continue
        _, path, out, header = stack[-1]
        own = ""
        if m["rest"]:
            for key, value in _ATTRIBUTE.findall(m["rest"]):
                key, value = key.lower(), value.strip("\"'").strip()
                if key in ("class", "id"):
                    own += ("." if key == "class" else "#") + _SPACE.sub(".", value.lower())
                    out = out or (name not in ("html", "body", "p", "h1") and bool(_OUT_NAMES.search(value)) and not (name in ("article", "main")  and "comment" not in value.lower()))
                elif key == "role":
                    out = out or value.lower() in _OUT_ROLES
                    own += "~main" if value.lower() in ("main", "article") else ""
                elif key == "hidden" or value.lower() == "true":
                    out = True
        out = out or name in _OUT
        header = header or name == "header"
        if name in _CONTAINERS:
            path = f"{path}/{name}{re.sub('[0-9]+', '0', own)}"
        if marks is not None and name in _BLOCKS and not (out or header):
            marks.append((path, f"<{name}", 0))
        stack.append((name, path, out, header))
    run.append(page[at:] if page[at : at + 1] != "<" else "")
    flush()
    return blocks


def rank(path: str) -> int:
    """How clearly a container's own markup says that it holds the article."""
    last = path.rpartition("/")[2]
    name = re.split(r"[.#~]", last, maxsplit=1)[0]
    if name == "article":
        return 3
    if name == "main" or "~main" in last:
        return 2
    return 1 if _MAIN_NAMES.search(re.sub(r"[.#~]", " ", last.removeprefix(name))) else 0


def main_path(sizes: dict[str, int]) -> str | None:
    """The slot of the article: of the containers marked most clearly, the one with most text in it, the outermost on a tie.

    ``sizes``: characters of varying text directly in each container."""
    below: Counter[str] = Counter()
    for path, n in sizes.items():
        parts = path.split("/")
        for k in range(2, len(parts) + 1):
            below["/".join(parts[:k])] += n
    marked = [(rank(p), n, -len(p), p) for p, n in below.items() if n]
    if not marked:
        return max(sizes, key=sizes.get) if sizes else None
    best = max(marked)
    if best[0]:
        return best[3]
    # unmarked: the container with most text of its own, widened while its parent holds more than half as much again beside it
    path = max(sizes, key=lambda p: (sizes[p], -len(p)))
    while (up := path.rpartition("/")[0]) and below[up] > 1.5 * below[path]:
        path = up
    return path


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def _marked(page: str) -> list[tuple[str, int, int]]:
    """The tokens of a page in page order: path, hash and characters."""
    marks: list[tuple[str, str, int]] = []
    read_blocks(page, marks)
    return [(path, _hash(path, value) if size else _hash(path, value, "tag"), size) for path, value, size in marks]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per distinct token of a page, with its size, its first place and its entry of the occurrence vector."""
    for batch in batches:
        for part in common.pieces(batch, "html", 4 << 20):
            rows: list[tuple] = []
            for host, key, page in zip(*(part.column(c).to_pylist() for c in ("host", "page_key", "html"))):
                seen: dict[tuple[str, int], list[int]] = {}
                for place, (path, token, size) in enumerate(_marked(page)):
                    seen.setdefault((path, token), [0, size, place])[0] += 1
                for (path, token), (n, size, place) in seen.items():
                    vector = xxhash.xxh64_intdigest(f"{key}:{n}")
                    rows.append((host, path, token, n * size, place, vector & 0xFFFFFFFF, vector >> 32))
            kinds = (pa.string(), pa.string(), *[pa.int64()] * 5)
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["host", "path", "token", "size", "place", "low", "high"])


def broken_classes(tokens: list[int], order: dict[int, tuple[int, int]], lengths: list[int]) -> tuple[set[int], set[int]]:
    """The classes on a page, and those of them whose tokens do not come in order or that cross another one. ``order``: class and place in
    it of a token; ``lengths``: tokens of each class. Of two classes that cross the one with the greater number is broken."""
    present: set[int] = set()
    broken: set[int] = set()
    opened: list[list[int]] = []  # class and next place, from the outermost on
    for token in tokens:
        if token not in order:
            continue
        k, place = order[token]
        present.add(k)
        at = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == k), None)
        if (opened[at][1] if at is not None else 0) != place:
            broken.add(k)
            if at is not None:
                del opened[at]
            if place:
                continue
            at = None
        if at is None:
            at = len(opened)
            opened.append([k, 0])
        inner = [x[0] for x in opened[at + 1 :]]
        if inner and min(inner) < k:
            broken.add(k)
            del opened[at]
            continue
        broken.update(inner)
        del opened[at + 1 :]
        opened[at][1] += 1
        if opened[at][1] == lengths[k]:
            opened.pop()
    return present, broken | {x[0] for x in opened}


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per page and class on it: is it broken there, and the characters of the page outside of all classes."""
    known: dict[str, tuple[list, dict[int, tuple[int, int]]]] = {}
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        for part in common.pieces(batch, "html", 4 << 20):
            rows: list[tuple] = []
            for host, page, classes in zip(*(part.column(c).to_pylist() for c in ("host", "html", "classes"))):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    classes = sorted(classes, key=lambda c: (-c["n_pages"], c["low"], c["high"]))
                    known[host] = (classes, {t: (k, i) for k, c in enumerate(classes) for i, t in enumerate(c["tokens"])})
                classes, order = known[host]
                tokens = _marked(page)
                free = sum(size for _, token, size in tokens if token not in order)
                present, broken = broken_classes([token for _, token, _ in tokens], order, [len(c["tokens"]) for c in classes])
                rows += [(host, classes[k]["low"], classes[k]["high"], int(k in broken), free) for k in present]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["host", "low", "high", "broken", "free"])


def distinct_pages(pages: DataFrame) -> DataFrame:
    """``pages(host, page_key, html)`` with one row for the copies of a page on a host. Only copied pages are grouped, on the map side first."""
    counted = pages.groupBy(F.xxhash64("host", "page_key").alias("copied")).agg(F.count(F.lit(1)).alias("n"))
    copied = common.stage_table(counted.where("n > 1").select("copied"), "page-copies")
    keyed = pages.select("host", "page_key", "html", F.xxhash64("host", "page_key").alias("copied"))
    once = keyed.join(copied, "copied", "left_semi").groupBy("host", "page_key").agg(F.any_value("html").alias("html"))
    return keyed.join(copied, "copied", "left_anti").select("host", "page_key", "html").unionByName(once)


def equivalence_classes(frequent: DataFrame) -> DataFrame:
    """host, low, high, n_pages, size and the tokens in page order of every large class of ``frequent`` tokens."""
    classes = frequent.groupBy("host", "low", "high").agg(
        F.sort_array(F.collect_list(F.struct("place", "token"))).alias("placed"), F.sum("size").alias("size"), F.first("n_pages").alias("n_pages"))
    return classes.where(F.size("placed") >= MIN_TOKENS).select("host", "low", "high", "n_pages", "size", F.col("placed.token").alias("tokens"))


def templates(pages: DataFrame) -> DataFrame:
    """host, its main slot and the hashes of its template's text runs; from ``pages(host, page_key, html)``, equal keys for equal pages."""
    pages = distinct_pages(pages)
    tokens = pages.mapInArrow(_tokens, "host string, path string, token long, size long, place long, low long, high long")
    runs = tokens.groupBy("host", "path", "token").agg(F.count(F.lit(1)).alias("n_pages"), *[F.sum(c).alias(c) for c in ("size", "place", "low", "high")])
    runs = common.stage_table(runs, "page-runs")
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    frequent = runs.where(F.col("n_pages") >= MIN_PAGES).join(hosts, "host").where(F.col("n_pages") >= MIN_SHARE * F.col("host_pages"))
    classes = common.stage_table(equivalence_classes(frequent), "page-classes")
    of_host = classes.groupBy("host").agg(F.collect_list(F.struct("low", "high", "n_pages", "tokens")).alias("classes"))
    held = pages.select("host", "html").join(of_host, "host").mapInArrow(_held, "host string, low long, high long, broken long, free long")
    held = held.groupBy("host", "low", "high").agg(F.sum("broken").alias("broken"), F.sum("free").alias("free"))
    key = ["host", "low", "high"]
    kept = common.stage_table(classes.join(held, key).where("broken = 0 AND free >= size").select(key), "page-kept")
    fixed = common.stage_table(frequent.where("size > 0").join(kept, key).select("host", "path", "token", "size"), "page-fixed")
    known = fixed.groupBy("host", "path").agg(F.sum("size").alias("fixed"))
    sizes = (
        runs.where("size > 0").groupBy("host", "path").agg(F.sum("size").alias("size")).join(known, ["host", "path"], "left")
        .select("host", "path", (F.col("size") - F.coalesce("fixed", F.lit(0))).alias("size"))
    )
    found = main_slots(sizes)
    fixed = fixed.groupBy("host").agg(F.collect_list("token").alias("template"))
    return hosts.join(found, "host", "left").join(fixed, "host", "left").select("host", "slot", F.coalesce("template", F.array().cast("array<long>")).alias("template"))


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per path and container around it, with the path's size in it; ``own`` where it is the path itself."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    for batch in batches:
        rows: list[tuple] = []
        for host, path, size in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "size"))):
            parts = path.split("/")
            rows += [(host, up, rank(up), None, size) for up in ("/".join(parts[:k]) for k in range(2, len(parts)))]
            rows.append((host, path, rank(path), size, size if path else 0))
            if len(rows) > 10_000:
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["host", "path", "rank", "own", "below"])
                rows = []
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["host", "path", "rank", "own", "below"])


def main_slots(sizes: DataFrame) -> DataFrame:
    """host and slot, as ``main_path`` has it for each host's ``sizes(host, path, size)``; sums and maxima only, no host's paths
    are collected. Of equal containers the greatest path is taken."""
    around = sizes.mapInArrow(_above, "host string, path string, rank int, own long, below long")
    around = common.stage_table(around.groupBy("host", "path", "rank").agg(F.sum("own").alias("own"), F.sum("below").alias("below")), "page-slots")
    short = (-F.length("path")).alias("short")
    best = around.groupBy("host").agg(F.max(F.when(F.col("below") > 0, F.struct("rank", "below", short, "path"))).alias("marked"),
                                      F.max(F.when(F.col("own").isNotNull(), F.struct("own", short, "path"))).alias("widest"))
    clear = F.coalesce(F.col("marked.rank"), F.lit(0)) > 0
    # unmarked: only the containers around the one widest path of a host are looked up, from the inside out
    parts = F.split("widest.path", "/")
    ups = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))
    chain = (
        best.where(~clear).select("host", F.explode(ups).alias("path")).join(around, ["host", "path"])
        .groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("path").alias("length"), "path", "below")), asc=False).alias("chain"))
    )
    start = F.struct(F.get("chain", F.lit(0))["path"].alias("path"), F.get("chain", F.lit(0))["below"].alias("below"), F.lit(False).alias("done"))

    def widen(acc: Column, x: Column) -> Column:
        more = ~acc["done"] & (x["below"] > 1.5 * acc["below"])
        return F.struct(F.when(more, x["path"]).otherwise(acc["path"]).alias("path"), F.when(more, x["below"]).otherwise(acc["below"]).alias("below"), (~more).alias("done"))

    wide = F.aggregate(F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(0))), start, widen, lambda acc: acc["path"])
    slot = F.when(clear, F.col("marked.path")).otherwise(F.coalesce(wide, F.col("widest.path")))
    return best.join(chain, "host", "left").select("host", slot.alias("slot"))


def main_text(page: str, slot: str | None, template: frozenset[int]) -> str:
    blocks = [b for b in read_blocks(page) if not b.out]
    within = lambda path, slot: path == slot or path.startswith(slot + "/")
    kept = [b for b in blocks if slot is not None and within(b.path, slot)]
    if not kept and blocks:
        sizes: Counter[str] = Counter()
        for b in blocks:
            if _hash(b.path, b.text) not in template:
                sizes[b.path] += len(b.text)
        own = main_path(sizes)
        kept = [b for b in blocks if own is not None and within(b.path, own)]
    texts: list[str] = []
    follows = False  # does the next block stay
    for b in reversed(kept):
        follows = _hash(b.path, b.text) not in template or (b.heading and follows)
        if follows:
            texts.append(b.text)
    return "\n\n".join(reversed(texts))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[str | None, frozenset[int]]] = {}
    for batch in batches:
        for part in common.pieces(batch, "html", 4 << 20):
            texts = []
            for host, page, slot, template in zip(*(part.column(c).to_pylist() for c in ("host", "html", "slot", "template"))):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = (slot, frozenset(template or []))
                texts.append(main_text(page, *known[host]))
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of every row of ``pages(page_id, url, html)``."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.whole_text("html").alias("html"))
    pages = pages.withColumn("host", host).withColumn("page_key", F.xxhash64("html"))
    found = common.stage_table(templates(pages), "page-templates")
    # the join only adds a host's one slot and its template to its pages: large partitions of a hot host can be split at run time
    joined = pages.select("host", "page_id", "url", "html").join(found, "host", "left")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
