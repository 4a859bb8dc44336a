"""Small embeddings tables with odd rows, and what is left of them by plain Python."""

import math

import numpy as np

SCHEMA = "vec_id long, embedding array<float>, label int, vector int, n string, cluster double"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows, parts=3):
    """rows: (vec_id, components, label); further columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, 1, "n", 0.5) for i, v, k in rows], SCHEMA).repartition(parts)


def odd_rows(dim=64):
    one = [0.5] * dim
    return [(900, None, 1), (901, [], 1), (902, [None, *one[1:]], 1), (903, [NAN, *one[1:]], 1), (904, [INF, *one[1:]], None), (905, [-INF, *one[1:]], 2)]


def clustered(seed, n, dim=64, centres=6, spread=0.06):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    x = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim)) * rng.choice([0.5, 1, 3, 20], size=(n, 1))
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def whole(v, dim=64):
    """floor(1024 x), or None for a row that is not kept."""
    if v is None or len(v) != dim or any(x is None or not math.isfinite(x) or abs(x) >= 65536 for x in v):
        return None
    return [math.floor(1024 * float(np.float32(x))) for x in v]
