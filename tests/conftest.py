import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from oeeforge.session import get_spark

    return get_spark(master="local[*]", shuffle_partitions=8, app="oeeforge-tests")


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="oeeforge-test-")


def rows_frame(spark, rows, **extra):
    """Staged rows from dicts (history names); missing columns are NULL."""
    from oeeforge import schema as S

    base = {name: None for name in S.DATA_COLUMNS}
    data = []
    for i, r in enumerate(rows):
        d = dict(base)
        d.update(r)
        d.setdefault(S.SOURCE_FILE, "f1")
        d.setdefault(S.ROW_INDEX, i)
        data.append(d)
    from pyspark.sql import types as T

    schema = T.StructType(list(S.STAGED_SCHEMA.fields) + [
        T.StructField(S.SOURCE_FILE, T.StringType()), T.StructField(S.ROW_INDEX, T.LongType())])
    return spark.createDataFrame([tuple(d[f.name] for f in schema.fields) for d in data], schema)
