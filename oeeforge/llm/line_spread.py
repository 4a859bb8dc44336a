"""Operator 10: cross-site boilerplate lines, by their distinct-site spread.

Every line is hashed; one HyperLogLog sketch of its sites per line hash is built on the map side and merged by
the aggregation, so that a line on a third of all rows crosses the shuffle as one sketch per task. Lines
whose estimate is clearly over (or under) the threshold are decided by it; those near it get an exact distinct count.
Lines that spread over at least ``min_sites`` sites are taken out of all texts.

Sites are counted over distinct texts: a text that stands on many sites word for word counts for one of them (the least), so a
copied document is no boilerplate by being copied; near-duplicate removal deals with copies. Lines of fewer than
``min_chars`` characters never count: short sentences and headings recur on many sites by chance.

Defined cases: a null text is empty, and stays null; a null site counts as one site of its own. Lines are
compared without the spaces around them. Rows are matched by doc_id
and a hash of the text, so null and repeated ids are no trouble; equal rows get equal results. Empty tables give
empty results. Extra columns pass through unchanged, whatever their names (the added columns lines_total and lines_removed
take underscores where a name is taken); a column n_chars is brought up to date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common

MIN_SITES = 8
MIN_CHARS = 20
#: log2 of the sketch's registers (standard error about 3 %) and the band around the threshold that is counted exactly.
LOG_K = 10
BAND = 0.15


def _lines(column: Column) -> Column:
    return F.split(column, "\n", -1)


def _site(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit(""))


def _exploded(docs: DataFrame, text: str, *own: Column) -> DataFrame:
    """A row per line: the columns asked for, the line's hash, and its position."""
    return (
        docs.select(*own, F.posexplode(_lines(common.whole_text(text))).alias("pos", "line"))
        .withColumn("size", F.length(F.trim("line"))).withColumn("line_hash", F.xxhash64(F.trim("line"))).drop("line")
    )


def spread_lines(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """line_hash of every line of ``min_chars`` that occurs on at least ``min_sites`` distinct sites."""
    hashed = docs.select(_site(site).alias("site"), F.xxhash64(common.whole_text(text)).alias("text_hash"))
    # texts on several sites count for the least one; few, against all texts
    copied = hashed.groupBy("text_hash").agg(F.min("site").alias("least"), F.max("site").alias("most")).where("least <> most")
    copied = common.stage_table(copied.select(F.col("text_hash").alias("_copied"), "least"), "copied-texts")
    lines = _exploded(docs, text, _site(site).alias("site"), F.xxhash64(common.whole_text(text)).alias("text_hash")).where(F.col("size") >= min_chars)
    lines = lines.join(copied, F.col("text_hash") == F.col("_copied"), "left").select("line_hash", F.coalesce("least", "site").alias("site"))
    estimate = lines.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("sites"))
    wide = common.stage_table(estimate.where(F.col("sites") >= min_sites * (1 - BAND)), "line-spread")
    near = wide.where(F.col("sites") < min_sites * (1 + BAND)).select("line_hash")
    exact = (
        lines.join(near, "line_hash", "left_semi").distinct().groupBy("line_hash").agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return wide.where(F.col("sites") >= min_sites * (1 + BAND)).select("line_hash").unionByName(exact.select("line_hash"))


def remove_spread_lines(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES,
                        min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``, and the added columns lines_total and lines_removed."""
    columns = docs.columns
    spread = common.stage_table(spread_lines(docs, site, text, min_sites, min_chars), "boilerplate-lines")
    whole = common.whole_text(text)
    hits = (
        _exploded(docs, text, F.col("doc_id").alias("hit_id"), F.xxhash64(whole).alias("hit_text")).where(F.col("size") >= min_chars)
        .join(spread, "line_hash", "left_semi")
        .groupBy("hit_id", "hit_text").agg(F.collect_set("pos").alias("gone"))  # equal rows meet in one group, with equal positions
    )
    work = common.packed(docs, F.col("doc_id").alias("key"), whole.alias("whole"), F.xxhash64(whole).alias("text_hash"))
    joined = work.join(hits, F.col("key").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_text")), "left")
    every = _lines(F.col("whole"))
    places = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("gone"))
    taken = F.col("gone").isNotNull()
    joined = joined.withColumn("left", F.when(taken, F.array_join(F.transform(places, lambda i: F.get(every, i)), "\n")))
    out = dict(zip(columns, common.unpacked(columns)))
    out[text] = F.when(taken, F.col("left")).otherwise(F.col("row").getField(text)).alias(text)
    if "n_chars" in columns:
        out["n_chars"] = F.when(taken, F.length("left")).otherwise(F.col("row").getField("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    total, removed = (common.fresh(c, columns) for c in ("lines_total", "lines_removed"))
    return joined.select(*out.values(), F.size(every).cast("long").alias(total), F.when(taken, F.size("gone")).otherwise(0).cast("long").alias(removed))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_spread_lines(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return done.select("doc_id", "lines_total", "lines_removed", F.length(common.whole_text()).cast("long").alias("n_chars"),
                       F.md5(F.encode(common.whole_text(), "UTF-8")).alias("text_md5"))


#: The rows of every document with its lines flagged; also the base of the pipeline's SQL.
LINES_SQL = f"""
t AS (SELECT coalesce(text, '') AS text, min(coalesce('s' || source, '')) AS site FROM documents GROUP BY 1),
l AS (
  SELECT doc_id, t.site, unnest(string_split(t.text, chr(10))) AS line, generate_subscripts(string_split(t.text, chr(10)), 1) AS pos
  FROM documents d JOIN t ON coalesce(d.text, '') = t.text),
b AS (
  SELECT trim(line) AS line FROM l WHERE length(trim(line)) >= {MIN_CHARS} GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
f AS (
  SELECT l.doc_id, l.line, l.pos, b.line IS NOT NULL AS hit FROM l LEFT JOIN b ON trim(l.line) = b.line),
k AS (
  SELECT doc_id, count(*) AS lines_total, count(*) FILTER (WHERE hit) AS lines_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '') AS text
  FROM f GROUP BY 1)
"""

ORACLE_SQL = f"WITH {LINES_SQL} SELECT doc_id, lines_total, lines_removed, length(text) AS n_chars, md5(text) AS text_md5 FROM k"
