import os
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from conftest import SF001
from oeeforge import schema as S
from oeeforge.sources import exports as X
from oeeforge.sources.production_view import production_view


def _col(i):
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _xlsx(path, sheets):
    """Minimal workbook (inline strings) with {sheet name: rows}."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        wb = ['<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
              'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>']
        rels = ['<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">']
        for k, (name, rows) in enumerate(sheets.items(), start=1):
            wb.append(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>')
            rels.append(f'<Relationship Id="rId{k}" Type="worksheet" Target="worksheets/sheet{k}.xml"/>')
            xml = ['<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>']
            for i, row in enumerate(rows, start=1):
                xml.append(f'<row r="{i}">')
                for j, v in enumerate(row):
                    ref = f"{_col(j)}{i}"
                    if v is None:
                        continue
                    if isinstance(v, str):
                        xml.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
                    else:
                        xml.append(f'<c r="{ref}"><v>{float(v)!r}</v></c>')
                xml.append("</row>")
            xml.append("</sheetData></worksheet>")
            z.writestr(f"xl/worksheets/sheet{k}.xml", "".join(xml))
        z.writestr("xl/workbook.xml", "".join(wb) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "".join(rels) + "</Relationships>")


def test_workbooks_read_like_the_view(spark, tmpdir_path):
    folder = f"{tmpdir_path}/xlsx"
    os.makedirs(folder)
    view = production_view(spark, SF001)
    first = sorted(r[0] for r in view.select(S.SOURCE_FILE).distinct().collect())[0]
    pdf = view.filter(F.col(S.SOURCE_FILE) == first).orderBy(S.ROW_INDEX).toPandas()
    header = [S.LABEL[c] for c in S.DATA_COLUMNS]
    rows = [header] + [[None if (isinstance(v, float) and v != v) else v for v in r]
                       for r in pdf[S.DATA_COLUMNS].itertuples(index=False, name=None)]
    _xlsx(f"{folder}/{first}.xlsx", {"Résumé": [["x"]], X.REQUIRED_SHEET: rows})
    _xlsx(f"{folder}/other.xlsx", {"Feuil1": [["a"], ["b"]]})
    with open(f"{folder}/broken.xlsx", "wb") as fh:
        fh.write(b"not a zip")

    sheets = {(r.source_file, r.sheet_name) for r in X.workbook_sheets(spark, folder).collect()}
    assert (f"{first}.xlsx", X.REQUIRED_SHEET) in sheets and ("other.xlsx", "Feuil1") in sheets
    parsed = X.read_workbooks(spark, folder)
    status = {r.source_file: r._status for r in parsed.filter(F.col("_status").isNotNull()).collect()}
    assert status == {"other.xlsx": "SHEET_NOT_FOUND", "broken.xlsx": "CORRUPTED"}
    staged, missing = X.normalise(X.workbook_frame(parsed))
    assert missing == []
    got = staged.select(*S.DATA_COLUMNS, S.ROW_INDEX)
    want = view.filter(F.col(S.SOURCE_FILE) == first).select(*S.DATA_COLUMNS, S.ROW_INDEX)
    assert got.count() == len(pdf)
    assert got.exceptAll(want).count() == 0
    status = {r.source_file: r.status for r in X.file_status(
        spark, folder, staged, "xlsx", parsed.filter(F.col("_status").isNotNull())
        .select("source_file", F.col("_status").alias("status"))).collect()}
    assert status == {f"{first}.xlsx": "OK", "other.xlsx": "SHEET_NOT_FOUND", "broken.xlsx": "CORRUPTED"}
