from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001
from oeeforge.operators.row_index import with_file_row_index
from oeeforge.sources.production_view import ROW_ORDER, production_lines


def test_row_index_equals_per_file_row_number(spark):
    lines = production_lines(spark, SF001)
    got = with_file_row_index(lines, "_source_file", ROW_ORDER, "ri")
    w = Window.partitionBy("_source_file").orderBy(*ROW_ORDER)
    want = lines.withColumn("ri", (F.row_number().over(w) - 1).cast("long"))
    keys = ["_source_file", *ROW_ORDER, "ri"]
    assert got.count() == lines.count()
    assert got.select(*keys).exceptAll(want.select(*keys)).count() == 0
