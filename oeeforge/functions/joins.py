"""A small side of a join, staged so that its size is known.

``staged_side`` writes a side that is expected to be small as a Parquet stage table. Its files' bytes are then the planner's
estimate, so Spark sends it to the tasks if they are below ``spark.sql.autoBroadcastJoinThreshold`` and joins by
shuffle (with AQE's skew splitting) if not. No side is broadcast on a guess.

The planner holds a table's compressed bytes against that threshold, and the rows in memory can be thirty times as many: 1.2 million
rows of ``part`` are 5 MB of Parquet columns, but 144 MB that the driver collects and sends. ``by_shuffle`` keeps a side
that grows with the data, but packs that well, away from the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from oeeforge.session import materialize


def staged_side(small: DataFrame, name: str) -> DataFrame:
    return materialize(small, name)


def by_shuffle(side: DataFrame) -> DataFrame:
    """The side of an equi-join, joined by a sort-merge whatever its estimated size."""
    return side.hint("merge")


def hashed_by_shuffle(side: DataFrame) -> DataFrame:
    """The side of an equi-join, shuffled and hashed by task: the other side, of many more rows, is not sorted (nor spilled by a sort).

    A task holds its share of this side, so it is for sides that are a small part of the other.
    """
    return side.hint("shuffle_hash")
