"""Export folders as DataFrames.

* S1/S2 ``probe_files``: a file-parallel job reads every file of a folder (non-recursive) once, whole, and reports its
  status, its rows and its own layout. A file that cannot be read to its end is CORRUPTED and left out whole; the others
  continue.
* S1 ``load_exports``: the readable files in groups of equal layout, one typed read per group, then cast and union. A layout
  is a Parquet footer's names and types, or a text file's header; so files of other types or column orders do not
  disturb each other. CSV files in which a quoted cell holds a line feed are read record by record (such a file is one
  task); the others keep splitting by lines. The rows loaded from a text file must equal the probe's count; if not, the
  file is CORRUPTED and left out.
* S3 ``normalise``: drop unnamed columns, rename labels to history names, ``try_cast`` to the locked types, NaN -> NULL;
  missing required columns are added as typed NULLs (and reported by the Q1 structural finding). A cell whose type says
  nothing about the column (a list in a number column) is NULL.
* S4 lineage (``lineage=False`` leaves the extraction columns out): ``_source_file``, one ``_extracted_at`` per
  read, ``_row_index`` = 0-based BIGINT row within the file. Parquet: the reader's ``_metadata.row_index``. Text formats: the
  rows of a file's split are counted, a running sum over the splits gives each one's base, and a narrow pass adds it; no row
  is sorted or shuffled.
* S5/S2 ``file_status``: one row per file of the folder: OK, EMPTY (readable, no data rows),
  UNSUPPORTED (extension), CORRUPTED (unreadable), and FILE_NOT_FOUND for a
  missing folder.
* S1/S6 workbooks: ``read_workbooks`` / ``workbook_sheets`` read ``.xlsx``
  files with a file-parallel ``binaryFile`` + ``mapInPandas`` job (standard
  library zip/XML, one task per file batch).
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oeeforge import schema as S
from oeeforge.functions.columns import nan_to_null
from oeeforge.functions.files import list_files, open_input, path_exists
from oeeforge.session import materialize

FORMATS = {"parquet": (".parquet",), "csv": (".csv",), "json": (".json", ".jsonl"), "xlsx": (".xlsx", ".xlsm")}
WORKBOOK_EXTENSIONS = (".xlsx", ".xlsm")
REQUIRED_SHEET = "Détails Cadences"  # fixed value: the sheet the exports carry


PROBE_SCHEMA = "source_file string, path string, status string, n_rows long, columns array<string>, layout string"
TEXT_FORMATS = ("csv", "json")

#: Spark's type of a Parquet column by the name of its Arrow type; columns of other types (nested, times) have no usable cells.
_PARQUET_TYPES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint",
    "uint64": "decimal(20,0)", "float": "float", "double": "double", "bool": "boolean", "string": "string", "large_string": "string",
}


def _spark_type(kind) -> str | None:
    import pyarrow.types as pt

    if pt.is_dictionary(kind):
        return _spark_type(kind.value_type)
    if pt.is_decimal(kind) and kind.precision <= 38:
        return f"decimal({kind.precision},{kind.scale})"
    return _PARQUET_TYPES.get(str(kind))


def _probe(fmt: str, path: str, length: int) -> tuple[str, int, list[str], str]:
    """(status, rows, header, layout) of one file, read to its end; an exception means that it cannot be read."""
    import csv
    import json

    import pyarrow.parquet as pq

    if length == 0:
        return "EMPTY", 0, [], ""
    found = lambda rows, columns, layout: ("OK" if rows else "EMPTY", rows, columns, layout)
    with open_input(path) as source:
        if fmt == "parquet":
            file = pq.ParquetFile(source)
            names = file.schema_arrow.names
            if len({n.lower() for n in names}) < len(names):
                raise ValueError("columns of one name")  # no reader can tell them apart
            rows = sum(batch.num_rows for batch in file.iter_batches(batch_size=8192))
            return found(rows, names, json.dumps([(f.name, _spark_type(f.type)) for f in file.schema_arrow]))
        lines = io.TextIOWrapper(source, encoding="utf-8-sig", newline="")
        if fmt == "csv":
            reader = csv.reader(lines, strict=True)
            columns = next(reader, [])
            single, rows, before = reader.line_num == 1, 0, reader.line_num
            for r in reader:
                blank = not r or (len(r) == 1 and not r[0].strip())
                rows += not blank
                single = single and reader.line_num == before + 1
                before = reader.line_num
            return found(rows, columns, json.dumps(["lines" if single else "records", columns]))
        keys: dict[str, None] = {}
        rows = 0
        for line in lines:
            if line.strip():
                rows += 1
                keys.update(dict.fromkeys(json.loads(line)))
        return found(rows, list(keys), json.dumps(list(keys)))


def probe_paths(spark: SparkSession, listed: DataFrame, fmt: str) -> DataFrame:
    """The probe of files given as (name, path, length); each file is read by a task, as a stream."""

    def probe(it):
        for pdf in it:
            out = []
            for name, path, length in zip(pdf["name"], pdf["path"], pdf["length"]):
                if not name.lower().endswith(FORMATS[fmt]):
                    out.append((name, path, "UNSUPPORTED", 0, [], ""))
                    continue
                try:
                    out.append((name, path, *_probe(fmt, path, length)))
                except Exception:  # noqa: BLE001 - whatever keeps a file from being read is its status
                    out.append((name, path, "CORRUPTED", 0, [], ""))
            yield pd.DataFrame(out, columns=["source_file", "path", "status", "n_rows", "columns", "layout"])

    return materialize(listed.mapInPandas(probe, PROBE_SCHEMA), "file-probe")


def probe_files(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """A row per file of the folder, staged once: (source_file, path, status, n_rows, columns of its own header, layout).

    The driver lists the folder. A missing folder is one FILE_NOT_FOUND row.
    """
    if not path_exists(spark, folder):
        return spark.createDataFrame([(folder, folder, "FILE_NOT_FOUND", 0, [], "")], PROBE_SCHEMA)
    files = list_files(spark, folder)
    listed = spark.createDataFrame(files, "name string, path string, length long")
    return probe_paths(spark, listed.repartition(max(1, min(len(files), 10_000))), fmt)


def _groups(probed: DataFrame) -> list[tuple[str, list[str]]]:
    """(layout, paths) of the readable files. Their names pass through the driver, as for any file scan."""
    found: dict[str, list[str]] = {}
    for r in probed.filter("status = 'OK'").select("layout", "path").collect():
        found.setdefault(r.layout, []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path))  # a path, not a pattern
    return sorted(found.items())


def _read_group(spark: SparkSession, fmt: str, layout: str, paths: list[str]) -> DataFrame:
    """The export columns of files of one layout, by name, with their lineage."""
    import json

    described = json.loads(layout)
    labels = {label for label, _, _ in S.EXPORT_COLUMNS}
    if fmt == "parquet":
        wanted = [(n, t) for n, t in described if n in labels]
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in wanted if t])
        part = spark.read.schema(schema).parquet(*paths)
        nothing = [F.lit(None).cast("string").alias(n) for n, t in wanted if not t]
        return part.select(*[F.col(f"`{f.name}`") for f in schema.fields], *nothing, *_lineage(fmt))
    header = described[1] if fmt == "csv" else described
    # names that repeat or are empty are no export labels: they are read by place and dropped
    names = [c if c and header.index(c) == i else f"_c{i}" for i, c in enumerate(header)]
    reader = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in names]))
    if fmt == "json":
        part = reader.json(paths)
    else:
        reader = reader.option("header", "true").option("enforceSchema", "true").option("escape", '"')
        part = reader.option("multiLine", str(described[0] == "records").lower()).csv(paths)
    own = [c for c in names if c in labels]
    return part.select(*[F.col(f"`{c}`") for c in own], *_lineage(fmt))


def _lineage(fmt: str) -> list[Column]:
    # the reader gives names as in a URI; a plus sign stands for itself there
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias(S.SOURCE_FILE)
    if fmt == "parquet":
        return [name, F.col("_metadata.row_index").cast("long").alias(S.ROW_INDEX)]
    return [name, F.col("_metadata.file_block_start").alias("_blk"), F.monotonically_increasing_id().alias("_seq")]


def _typed(raw: DataFrame, label: str, dtype: T.DataType) -> Column:
    """S3: the column in its locked type; numbers that are NaN, and cells that cannot be read as the type, are NULL."""
    c, src = F.col(f"`{label}`"), raw.schema[label].dataType
    if isinstance(src, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.StringType):
        return c.cast("string")
    if not isinstance(src, (T.NumericType, T.StringType, T.BooleanType)):
        c = c.cast("string")
    if isinstance(dtype, T.IntegerType) and not isinstance(src, T.IntegralType):
        c = c.try_cast("double")  # whole numbers may be written with a decimal part
    typed = c if src == dtype else c.try_cast(dtype)
    return nan_to_null(typed) if isinstance(dtype, T.DoubleType) else typed


def normalise(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """S3: (staged DataFrame with history names, list of missing export labels)."""
    present = [c for c in raw.columns if not (c.startswith("Unnamed:") or re.fullmatch(r"_c\d+", c))]
    missing = [label for label, _, _ in S.EXPORT_COLUMNS if label not in present]
    cols = [(_typed(raw, label, dtype) if label in present else F.lit(None).cast(dtype)).alias(name) for label, name, dtype in S.EXPORT_COLUMNS]
    return raw.select(*cols, *[c for c in raw.columns if c.startswith("_")]), missing


def with_split_row_index(rows: DataFrame, file_col: str = S.SOURCE_FILE, out_col: str = S.ROW_INDEX) -> DataFrame:
    """S4 for text files: ``out_col`` from (_blk, _seq), the split's start and the scan order within the split.

    ``rows`` must be a staged table, so that both passes see the same numbers. A split is read in order by one task; the
    counts (one row per file and split) are summed along each file and joined to the rows.
    """
    splits = rows.groupBy(F.col(file_col).alias("_f"), F.col("_blk").alias("_b")).agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = rows.join(splits, F.col(file_col).eqNullSafe(F.col("_f")) & (F.col("_blk") == F.col("_b")))
    own = [c for c in rows.columns if c not in ("_blk", "_seq")]
    return joined.select(*own, (F.col("_base") + F.col("_seq") - F.col("_first")).alias(out_col))


def load_exports(spark: SparkSession, fmt: str, probed: DataFrame, extracted_at: str | None = None, lineage: bool = True) -> tuple[DataFrame, DataFrame]:
    """(staged export rows of the readable files, the probe with the final status of each file)."""
    groups = _groups(probed)
    staged = None
    for layout, paths in groups:
        part = normalise(_read_group(spark, fmt, layout, paths))[0]
        staged = part if staged is None else staged.unionByName(part)
    if staged is None:
        staged = spark.createDataFrame([], T.StructType([*S.STAGED_SCHEMA.fields, T.StructField(S.SOURCE_FILE, T.StringType()), T.StructField(S.ROW_INDEX, T.LongType())]))
    elif fmt in TEXT_FORMATS:
        rows = materialize(staged, "text-rows")
        loaded = rows.groupBy(F.col(S.SOURCE_FILE).alias("_f")).agg(F.count(F.lit(1)).alias("_loaded"))
        whole = F.coalesce("_loaded", F.lit(0)) == F.col("n_rows")
        checked = probed.join(loaded, F.col("source_file") == F.col("_f"), "left")
        status = F.when((F.col("status") == "OK") & ~whole, "CORRUPTED").otherwise(F.col("status"))
        probed = materialize(checked.withColumn("status", status).select(*probed.columns), "file-probe")
        bad = probed.filter("status = 'CORRUPTED'").select(F.col("source_file").alias("_f"))
        staged = with_split_row_index(rows.join(bad, F.col(S.SOURCE_FILE) == F.col("_f"), "left_anti"))
    if lineage:
        staged = staged.withColumn(S.EXTRACTED_AT, F.to_timestamp(F.lit(extracted_at)) if extracted_at else F.current_timestamp())
    return staged, probed


def read_exports(spark: SparkSession, folder: str, fmt: str = "parquet", extracted_at: str | None = None,
                 probed: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Staged export rows (history names + lineage) and the labels that no file has; ``probed``: the folder's probe, if there is one."""
    probed = probe_files(spark, folder, fmt) if probed is None else probed
    staged, probed = load_exports(spark, fmt, probed, extracted_at)
    here = {r[0] for r in probed.filter("status = 'OK'").select(F.explode("columns")).distinct().collect()}
    return staged, [label for label, _, _ in S.EXPORT_COLUMNS if label not in here]


def file_status(spark: SparkSession, folder: str, staged: DataFrame | None = None, fmt: str = "parquet",
                problems: DataFrame | None = None, probed: DataFrame | None = None) -> DataFrame:
    """(source_file, status, reason, n_rows) for every file of the folder, sorted by name.

    ``probed``: the folder's probe, if there is one. Workbooks have none: their counts come from ``staged``, and
    ``problems`` (source_file, status) has the SHEET_NOT_FOUND / CORRUPTED / EMPTY rows ``read_workbooks`` reports.
    """
    if fmt == "xlsx" and path_exists(spark, folder):
        files = spark.createDataFrame([f[:1] for f in list_files(spark, folder)], "source_file string")
        counts = staged.groupBy(F.col(S.SOURCE_FILE).alias("source_file")).agg(F.count(F.lit(1)).alias("n_rows"))
        reported = problems.select("source_file", F.col("status").alias("_reported")).distinct()
        known = F.lower(F.col("source_file")).rlike("[.](xlsx|xlsm)$")
        probed = files.join(counts, "source_file", "left").join(reported, "source_file", "left").withColumn(
            "status", F.when(~known, "UNSUPPORTED").when(F.col("_reported").isNotNull(), F.col("_reported"))
            .when(F.coalesce("n_rows", F.lit(0)) == 0, "EMPTY").otherwise("OK"))
    elif probed is None:
        probed = probe_files(spark, folder, fmt)
    status = F.col("status")
    reason = (
        F.when(status == "UNSUPPORTED", F.lit("extension not in " + ", ".join(FORMATS[fmt])))
        .when(status == "CORRUPTED", F.lit("cannot be read to its end"))
        .when(status == "EMPTY", F.lit("no data rows"))
        .when(status == "FILE_NOT_FOUND", F.lit("folder does not exist"))
        .when(status == "SHEET_NOT_FOUND", F.lit(f"sheet '{REQUIRED_SHEET}' not in the workbook"))
    )
    return probed.select("source_file", "status", reason.alias("reason"),
                         F.coalesce(F.col("n_rows"), F.lit(0).cast("long")).cast("long").alias("n_rows")).orderBy("source_file")


def file_columns(spark: SparkSession, folder: str, fmt: str = "parquet", probed: DataFrame | None = None) -> DataFrame:
    """Q1 input per readable file: (source_file, columns), from each file's own header as the probe read it."""
    probed = probe_files(spark, folder, fmt) if probed is None else probed
    named = F.filter("columns", lambda c: ~c.startswith("Unnamed:"))
    return probed.filter(F.col("status").isin("OK", "EMPTY") & (F.size("columns") > 0)).select("source_file", named.alias("columns"))


def structural_columns(missing: list[str], files: DataFrame) -> DataFrame:
    """Input of Q1: (source_file, columns present) for every file read."""
    present = [label for label, _, _ in S.EXPORT_COLUMNS if label not in missing]
    return files.select("source_file", F.array(*[F.lit(p) for p in present]).cast("array<string>").alias("columns"))


# --- workbooks (.xlsx) --------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}


def _sheets(z: zipfile.ZipFile) -> dict[str, str]:
    wb = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.findall("pr:Relationship", _NS)}
    out = {}
    for s in wb.findall("m:sheets/m:sheet", _NS):
        rid = s.get(f"{{{_NS['r']}}}id")
        t = target.get(rid, "")
        out[s.get("name")] = t if t.startswith("xl/") else "xl/" + t.lstrip("/")
    return out


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheet_rows(z: zipfile.ZipFile, path: str) -> list[list]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    rows = []
    for row in ElementTree.fromstring(z.read(path)).findall("m:sheetData/m:row", _NS):
        vals: dict[int, object] = {}
        for c in row.findall("m:c", _NS):
            t, v = c.get("t"), c.find("m:v", _NS)
            if t == "s" and v is not None:
                val: object = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            elif t == "str":
                val = v.text if v is not None else None
            elif t != "e" and v is not None and v.text is not None:
                val = float(v.text)
            else:
                val = None
            vals[_col_index(c.get("r"))] = val
        rows.append([vals.get(i) for i in range(max(vals) + 1)] if vals else [])
    return rows


def _cell_text(v: object) -> str | None:
    """Cell value as text: whole numbers without a decimal part (spreadsheets store every number as float)."""
    if v is None:
        return None
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(v)
    return str(v)


def workbook_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, sheet_name) for every workbook; unreadable files give no row."""
    def parse(it):
        for pdf in it:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(os.path.basename(path), n) for n in _sheets(z)]
                except Exception:  # noqa: BLE001 - reported by file_status
                    continue
            yield pd.DataFrame(out, columns=["source_file", "sheet_name"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(folder)
    return files.select("path", "content").mapInPandas(parse, "source_file string, sheet_name string")


def read_workbooks(spark: SparkSession, folder: str, sheet: str = REQUIRED_SHEET, header_row: int = 0) -> DataFrame:
    """S1 workbook mode: the named sheet of every workbook, one row per data row.

    Output: (source_file, _row_index, cells MAP<label, text>) plus (source_file,
    status) problems in a second output column ``_status`` (NULL for data rows).
    Use ``workbook_frame`` to turn it into labelled columns.
    """
    def parse(it):
        for pdf in it:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                name = os.path.basename(path)
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        sheets = _sheets(z)
                        if sheet not in sheets:
                            out.append((name, None, None, "SHEET_NOT_FOUND"))
                            continue
                        rows = _sheet_rows(z, sheets[sheet])
                except Exception:  # noqa: BLE001
                    out.append((name, None, None, "CORRUPTED"))
                    continue
                if len(rows) <= header_row + 1:
                    out.append((name, None, None, "EMPTY"))
                    continue
                header = [str(h) if h is not None else f"Unnamed: {i}" for i, h in enumerate(rows[header_row])]
                for i, r in enumerate(rows[header_row + 1:]):
                    cells = {header[j]: _cell_text(v) for j, v in enumerate(r) if j < len(header)}
                    out.append((name, i, cells, None))
            yield pd.DataFrame(out, columns=["source_file", "_row_index", "cells", "_status"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(folder)
    return files.select("path", "content").mapInPandas(
        parse, "source_file string, _row_index long, cells map<string,string>, _status string")


def workbook_frame(parsed: DataFrame) -> DataFrame:
    """Labelled text columns from ``read_workbooks`` (feed to ``normalise``)."""
    rows = parsed.filter(F.col("_status").isNull())
    return rows.select(
        *[F.col("cells").getItem(label).alias(label) for label, _, _ in S.EXPORT_COLUMNS],
        F.col("source_file").alias(S.SOURCE_FILE), F.col("_row_index").alias(S.ROW_INDEX),
    )
