"""Operator 12: near-duplicate vectors by an exact metric range join within labels, their link counts and components.

Two vectors of one label link when their cosine is 0.93 or more. On unit vectors the distance is a metric, and the cosine
limit is a radius r = sqrt(2 - 2 * 0.93), so:

1. Equal vectors of a label are one node (with a count) from the start: a group of copies, however large, is one row.
2. Pivots partition the nodes of each large label: a node's home is the cell of its nearest pivot. A node x is copied to another
   cell only if the triangle inequality allows a partner there: d(x, pivot) <= radius of the cell + r, and d(x, pivot) <=
   d(x, own pivot) + 2 r (and x lies within r of the plane between the two pivots, the same condition in Euclid's terms).
3. Cells join independently: a cell compares its home nodes with all nodes in it, so every node finds all its partners in its
   own cell, and the counts of a cell are final. A cell beyond a tile's size is cut into a grid of tiles (home block x block of
   nodes), each of which is a task's work with bounded memory: a block of home nodes is held, the others stream past it in matrix products.
4. A tile passes on a count per linked node, and per node one row that names a node of its component within the tile (never all
   pairs). Components then follow by passing on minima.

The pivots are taken far apart from a bounded sample; they decide the cost, not the result. Vectors without structure (all far from
each other) cannot be pruned by any pivots: there the cells amount to blocks of an all-against-all comparison of the label.

Cosines are computed in double precision by matrix products; within 1e-9 of the limit they are computed again with exactly
rounded sums.

Defined cases: rows with a null label, a null, empty or zero vector, or null or non-finite components link with nothing.
Vectors of different lengths do not link. Rows that repeat a vec_id are vectors of their own, and equal rows link. A component's id
is its smallest vec_id that is not null; a row of a null vec_id is kept only if its component has none. Empty tables give no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common, vectors
from oeeforge.llm.overlap_join import components

LEAST = 0.93
#: Nodes of a label per pivot, pivots of all labels together, nodes sampled for them, labels that have any.
CELL, PIVOTS, SAMPLE = 4096, 2048, 8192
#: Nodes of a tile's block, and how many of the others meet it in one product.
TILE, STRIP = 2048, 1024
#: Relative and absolute room for the rounding of distances.
ROOM = 1e-9

_KEY = "label_key long, dim int"
_DEALT = ["label_key", "dim", "cell", "home_block", "block", "role"]
#: Roles in a tile, in the order of the stream: home nodes to compare, home nodes that are also compared with, others.
HOME, BOTH, OTHER = 0, 1, 2


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; a power of two takes out their size first, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -exponent[:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def linked_exactly(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """cosine >= least, from exactly rounded sums of products."""
    x, y = (np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in (x, y))
    return math.fsum(x * y) >= least * math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))


def _rows(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), -1).astype(np.float64)


def far_apart(sample: np.ndarray, many: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before."""
    chosen, near = [0], 1 - sample @ sample[0]
    while len(chosen) < min(many, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, 1 - sample @ sample[chosen[-1]])
    return sample[sorted(set(chosen))]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def reach(to: np.ndarray, own: np.ndarray, radius: np.ndarray, between: np.ndarray, r: float) -> np.ndarray:
    """Which cells (columns) may hold a partner of the nodes (rows): by distances to all pivots, the own cell, and the cells' radii."""
    near = to[np.arange(len(to)), own][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        past = (to**2 - near**2) / (2 * between[own])  # how far the plane between the pivots is
    open_ = (to <= near + 2 * r + ROOM) & (to <= radius[None, :] + r + ROOM) & ~(past > r + ROOM) & (radius[None, :] >= 0)
    open_[np.arange(len(to)), own] = True
    return open_


def _by_label(batch: pa.RecordBatch, pivots: dict) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray | None]]:
    """(label, rows, unit vectors, their pivots) of a batch; a label without pivots has one cell."""
    keys = list(zip(batch.column("label_key").to_pylist(), batch.column("dim").to_pylist()))
    groups: dict[tuple[int, int], list[int]] = {}
    for i, k in enumerate(keys):
        groups.setdefault(k, []).append(i)
    lists = batch.column("vector")
    for key, rows in groups.items():
        at = np.array(rows)
        yield key, at, unit(_rows(lists.take(pa.array(at)))), pivots.get(key)


def _homes(pivots: dict):
    """Per task and cell of a label with pivots: its radius and the number of home nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius = {k: np.full(len(p), -1.0) for k, p in pivots.items()}
        count = {k: np.zeros(len(p), np.int64) for k, p in pivots.items()}
        for batch in batches:
            for key, _, x, own in _by_label(batch, pivots):
                to = distances(x, own)
                home = to.argmin(1)
                np.maximum.at(radius[key], home, to[np.arange(len(to)), home])
                count[key] += np.bincount(home, minlength=len(own))
        rows = [(*k, i, float(radius[k][i]), int(count[k][i])) for k in pivots for i in np.flatnonzero(count[k]).tolist()]
        yield _batch(rows, f"{_KEY}, cell int, radius double, n long")

    return run


def _counts(pivots: dict, radius: dict, between: dict, r: float):
    """Per task and cell: the number of nodes in it, copies from other cells included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {k: np.zeros(len(p), np.int64) for k, p in pivots.items()}
        for batch in batches:
            for key, _, x, own in _by_label(batch, pivots):
                to = distances(x, own)
                count[key] += reach(to, to.argmin(1), radius[key], between[key], r).sum(0)
        rows = [(*k, i, int(count[k][i])) for k in pivots for i in np.flatnonzero(count[k]).tolist()]
        yield _batch(rows, f"{_KEY}, cell int, n long")

    return run


def _deal(pivots: dict, radius: dict, between: dict, grids: dict, r: float):
    """The nodes dealt to the tiles of their cells, with their roles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places = [], []
            sizes, spread = (batch.column(c).to_pylist() for c in ("label_n", "spread"))

            def put(i: int, key: tuple[int, int], cell: int, grid: tuple[int, int], home: bool) -> None:
                high, wide = grid
                if grid == (1, 1):
                    dealt = [(*key, cell, 0, 0, BOTH if home else OTHER)]
                else:
                    dealt = [(*key, cell, spread[i] % high, b, HOME) for b in range(wide if home else 0)]
                    dealt += [(*key, cell, h, (spread[i] // high) % wide, OTHER) for h in range(high)]
                rows.extend(dealt)
                places.extend([i] * len(dealt))

            for key, at, x, own in _by_label(batch, pivots):
                if own is None:
                    for i in at.tolist():
                        put(i, key, 0, (-(-sizes[i] // TILE),) * 2, True)
                    continue
                to = distances(x, own)
                home = to.argmin(1)
                for i, j in zip(*(v.tolist() for v in np.nonzero(reach(to, home, radius[key], between[key], r)))):
                    put(int(at[i]), key, j, grids[key, j], j == home[i])
            for start in range(0, len(rows), 8192):
                part, own_rows = rows[start : start + 8192], pa.array(places[start : start + 8192], pa.int64())
                columns = [pa.array([p[k] for p in part], t) for k, t in enumerate((pa.int64(), *[pa.int32()] * 5))]
                yield pa.record_batch([*columns, *(batch.column(c).take(own_rows) for c in ("node", "n", "vector"))], [*_DEALT, "node", "n", "vector"])

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [f for f, _ in fields])


class Tile:
    """A block of home nodes that others stream past: a count per home node, and who is connected to whom."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, least: float):
        order = np.argsort(ids)
        self.ids, self.raw, self.least = ids[order], raw[order], least
        self.x = unit(self.raw)
        self.links = np.zeros(len(ids), np.int64)
        self.group = np.arange(len(ids))  # of each home node, the least place in its component so far
        self.others: list[tuple[np.ndarray, np.ndarray]] = []  # ids of linked others, and a home place that each is connected to

    def meet(self, ids: np.ndarray, raw: np.ndarray, n: np.ndarray) -> None:
        for at in range(0, len(ids), STRIP):
            self._strip(ids[at : at + STRIP], raw[at : at + STRIP], n[at : at + STRIP])

    def _strip(self, ids: np.ndarray, raw: np.ndarray, n: np.ndarray) -> None:
        cosine = self.x @ unit(raw).T
        linked = cosine >= self.least
        for i, j in zip(*np.nonzero(np.abs(cosine - self.least) <= ROOM)):
            linked[i, j] = linked_exactly(self.raw[i], raw[j], self.least)
        place = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        same = self.ids[place] == ids
        linked[place[same], np.flatnonzero(same)] = False
        rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(rows):
            return
        linked = linked[np.ix_(rows, columns)]
        self.links[rows] += (linked.astype(np.float64) @ n[columns].astype(np.float64)).astype(np.int64)
        none = len(self.ids)
        while True:  # home nodes and others take the least group that they are linked to
            of_other = np.where(linked, self.group[rows][:, None], none).min(0)
            of_home = np.where(linked, of_other[None, :], none).min(1)
            least = np.arange(none)
            np.minimum.at(least, self.group[rows], of_home)
            while (least != least[least]).any():
                least = least[least]
            after = least[self.group]
            if (after == self.group).all():
                break
            self.group = after
        self.others.append((ids[columns], of_other))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (node, a node of the same component): one for each node that has links here."""
        home = np.flatnonzero(self.links > 0)
        a, b = [self.ids[home]], [self.ids[self.group[home]]]
        for ids, place in self.others:
            a.append(ids)
            b.append(self.ids[self.group[place]])
        a, b = np.concatenate(a), np.concatenate(b)
        return a[a != b], b[a != b]

    def result(self) -> pa.RecordBatch:
        linked = np.flatnonzero(self.links > 0)
        a, b = self.edges()
        node, links = np.concatenate((self.ids[linked], a)), np.concatenate((self.links[linked], np.zeros(len(a), np.int64)))
        return pa.record_batch([pa.array(node), pa.array(links), pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(b)])], ["node", "links", "other"])


def _join(least: float):
    """Reads tiles, home nodes first: rows (node, links, null), and (node, 0, another node of its component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple] = []
        tile: Tile | None = None

        def opened() -> Tile:
            ids, raw, n, both = (np.concatenate([h[k] for h in held]) for k in range(4))
            new = Tile(ids, raw, least)
            if both.any():
                new.meet(ids[both], raw[both], n[both])
            return new

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in _DEALT[:-1]], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if a == b:
                    continue
                if key != tuple(keys[a]):
                    if held:
                        yield (tile or opened()).result()
                    key, held, tile = tuple(keys[a]), [], None
                part = batch.slice(a, b - a)
                raw = _rows(part.column("vector"))
                role, ids, n = (np.asarray(part.column(c)) for c in ("role", "node", "n"))
                home = role != OTHER
                if home.any():
                    held.append((ids[home], raw[home], n[home], role[home] == BOTH))
                if not home.all() and held:
                    tile = tile or opened()
                    tile.meet(ids[~home], raw[~home], n[~home])
        if held:
            yield (tile or opened()).result()

    return run


def _pivots(nodes: DataFrame, per_label: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Pivots of the largest labels: a fixed number, from a fixed number of sampled nodes."""
    large = per_label.where(F.col("label_n") > CELL).orderBy(F.col("label_n").desc(), "label_key", "dim").limit(PIVOTS // 2).collect()
    if not large:
        return {}
    want = {(r["label_key"], r["dim"]): -(-r["label_n"] // CELL) for r in large}
    most = max(1.0, 2 * sum(want.values()) / PIVOTS)
    mark = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    share = min(1.0, SAMPLE / sum(r["label_n"] for r in large))
    known = nodes.join(F.broadcast(nodes.sparkSession.createDataFrame(list(want), _KEY)), ["label_key", "dim"], "left_semi")
    sample: dict[tuple[int, int], list] = {}
    for r in known.where(mark < int(share * (1 << 30))).orderBy(mark, "node").limit(2 * SAMPLE).select("label_key", "dim", "vector").toLocalIterator():
        sample.setdefault((r["label_key"], r["dim"]), []).append(r["vector"])
    return {k: far_apart(unit(np.array(rows, np.float64)), max(2, int(want[k] / most))) for k, rows in sample.items()}


def _cells(nodes: DataFrame, pivots: dict, r: float) -> tuple[dict, dict, dict]:
    """Radius of every cell, distances between the pivots, and each cell's grid of tiles."""
    between = {k: distances(p, p) for k, p in pivots.items()}
    radius = {k: np.full(len(p), -1.0) for k, p in pivots.items()}
    grids: dict = {}
    if not pivots:
        return radius, between, grids
    own = nodes.join(F.broadcast(nodes.sparkSession.createDataFrame(list(pivots), _KEY)), ["label_key", "dim"], "left_semi").select("label_key", "dim", "vector")
    homes = {}
    for c in own.mapInArrow(_homes(pivots), f"{_KEY}, cell int, radius double, n long").groupBy("label_key", "dim", "cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect():
        radius[c["label_key"], c["dim"]][c["cell"]] = c["radius"]
        homes[(c["label_key"], c["dim"]), c["cell"]] = c["n"]
    counted = own.mapInArrow(_counts(pivots, radius, between, r), f"{_KEY}, cell int, n long").groupBy("label_key", "dim", "cell").agg(F.sum("n").alias("n"))
    for c in counted.collect():
        at = (c["label_key"], c["dim"]), c["cell"]
        grids[at] = (1, 1) if c["n"] <= TILE else (-(-homes[at] // TILE), -(-c["n"] // TILE))
    return radius, between, grids


def join(table: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``table(vec_id, embedding, label)``."""
    spark = table.sparkSession
    r = math.sqrt(2 - 2 * least)
    vector = F.col("embedding")
    usable = F.col("label").isNotNull() & vectors.finite(vector) & F.exists(vector, lambda x: x != 0)
    integral = table.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").select(
        "vec_id", F.coalesce(usable, F.lit(False)).alias("usable"), "label", "embedding")
    spread = F.coalesce(F.col("vec_id"), F.lit(0))  # rows that link with nothing do not gather under one key
    rows = rows.select(
        "vec_id", "usable",
        F.when(F.col("usable"), F.col("label").cast("long") if integral else F.xxhash64("label")).otherwise(spread).alias("label_key"),
        F.when(F.col("usable"), F.size(vector)).otherwise(-1).alias("dim"),
        F.when(F.col("usable"), F.xxhash64(vector)).otherwise(spread).alias("h1"),
        F.when(F.col("usable"), F.xxhash64(F.lit(1), vector)).otherwise(0).alias("h2"),
        vector.alias("vector"),
    )
    same = ["label_key", "dim", "h1", "h2"]
    kind = table.schema["embedding"].dataType.simpleString()
    nodes = rows.where("usable").groupBy(*same).agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"))
    nodes, nodes_at = common.staged(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    per_label = nodes.groupBy("label_key", "dim").agg(F.count(F.lit(1)).alias("label_n"))
    pivots = _pivots(nodes, per_label)
    radius, between, grids = _cells(nodes, pivots, r)
    sized = nodes.join(per_label, ["label_key", "dim"]).where("label_n > 1")
    sized = sized.select("label_key", "dim", "label_n", F.pmod(F.xxhash64("node", F.lit(2)), F.lit((1 << 31) - 1)).cast("int").alias("spread"), "node", "n", "vector")
    dealt = sized.mapInArrow(_deal(pivots, radius, between, grids, r), f"{_KEY}, cell int, home_block int, block int, role int, node long, n long, vector {kind}")
    tiles = dealt.repartition(common.partitions(spark), *_DEALT[:-1]).sortWithinPartitions(*_DEALT)
    found, found_at = common.staged(tiles.mapInArrow(_join(least), "node long, links long, other long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))
    per_node = nodes.select(*same, "node", "n", "least_id").join(links, "node", "left")
    if edges.isEmpty():
        per_node = per_node.withColumn("component_id", F.col("least_id"))
    else:
        labels = components(edges.distinct())
        named = per_node.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        per_node = named.join(named.groupBy("comp").agg(F.min("least_id").alias("component_id")), "comp")
    per_node = common.stage_table(per_node.select(*same, "n", "links", "component_id"), "vector-components")
    common.discard(spark, nodes_at, found_at)
    out = rows.drop("vector").join(per_node, same, "left")
    out = out.withColumn("component_id", F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")))
    links = F.when(F.col("usable"), F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(0).cast("long")
    return out.select("vec_id", links.alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS MATERIALIZED (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS size FROM v),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) >= {LEAST} * a.size * b.size),
reach AS (SELECT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counted c ON e.vec_id = c.a LEFT JOIN least l ON e.vec_id = l.a"""
