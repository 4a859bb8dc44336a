"""Where the rows of repeated keys stand, for the duplicate-key rule (Q3) and the first row of a key (L3).

Both ask for keys that occur more than once. The keys' hashes are counted once (16 bytes a key are shuffled, not its texts); of the rows whose
hash occurs more than once the key, the file and the place are staged, few as a rule, and both steps read them alone. A
hash shared by different keys only adds rows that the steps find to be single.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeeforge import schema as S
from oeeforge.functions.joins import staged_side

#: The columns of ``repeated_places``.
FILE, AT = "source_file", "at"


def repeated_places(rows: DataFrame) -> DataFrame:
    """(code_of, machine, source_file, at) of every row, staged or in the history, whose key (nulls are equal) may occur more than once.

    ``at`` is the row's place where the rows have one, else its index.
    """
    file = S.SOURCE_FILE if S.SOURCE_FILE in rows.columns else "source_file"
    at = next((c for c in (S.PLACE, S.ROW_INDEX, "row_index") if c in rows.columns), None)
    place = F.lit(None).cast("long") if at is None else F.col(at) if at == S.PLACE else F.col(at).cast("long")
    key = F.xxhash64(*S.KEY_COLUMNS)
    counted = rows.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = staged_side(counted.where("_n > 1").select("_key"), "repeated-keys")
    found = rows.select(*S.KEY_COLUMNS, F.col(file).alias(FILE), place.alias(AT), key.alias("_key")).join(repeated, "_key", "left_semi")
    return staged_side(found.drop("_key"), "repeated-places")
