"""Approximate nearest neighbours: vantage-point trees per shard, and vantage points over the shards.

At most ``PIVOTS`` sampled vectors are vantage points of the whole table: each vector belongs to the
cell of the nearest one, and a cell keeps its ring, the least and greatest distance of its vectors
from its own vantage point and from ``RINGS`` others.  Cells are cut into shards of about ``SHARD``
vectors, and each shard has a vantage-point tree, whose nodes keep a vantage point and the median
distance of their points to it.

A query first searches one shard of its own cell; the distance of its k-th best is its radius.  It
then goes only to the cells whose rings lie within ``factor`` times that radius, and in a tree only
down the branches within ``factor`` times the k-th best so far, by the triangle inequality: factor
one is exact search, less prunes more.  Queries travel to shards; a shard's vectors are sent to
one task a phase, and only the best of each query leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD, LEAF, PIVOTS, RINGS = 4096, 128, 1024, 16
#: Queries that a task works on at once.
TOGETHER = 512
#: Rows of a table by length of vectors that may be broadcast.
LENGTHS = 10_000
FACTOR = 0.3

ROW = "vec_id long, dim int, vector binary"
ASSIGNED = "vec_id long, dim int, cell int, vector binary, away array<double>"
SHARDS = "dim int, cell int, sub int, n int, ids binary, vectors binary, nodes binary"
_NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("near", "<i4"), ("far", "<i4"), ("radius", "<f8")])


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): point ``order[start]`` is an inner node's vantage point; leaves have near = -1."""
    order, nodes = np.arange(len(vectors), dtype=np.int32), [(0, len(vectors), -1, -1, 0.0)]
    todo = [0]
    while todo:
        k = todo.pop()
        start, end = nodes[k][:2]
        if end - start <= LEAF:
            continue
        # the point farthest from the first stands at the rim, where spheres cut best
        part = order[start:end]
        rim = int(np.argmax(((vectors[part] - vectors[part[0]]) ** 2).sum(1)))
        part[[0, rim]] = part[[rim, 0]]
        away = np.sqrt(((vectors[part[1:]] - vectors[part[0]]) ** 2).sum(1))
        by = np.argsort(away, kind="stable")
        part[1:] = part[1:][by]
        middle = start + 1 + len(by) // 2
        nodes[k] = (start, end, len(nodes), len(nodes) + 1, float(away[by[len(by) // 2]]))
        todo += [len(nodes), len(nodes) + 1]
        nodes += [(start + 1, middle, -1, -1, 0.0), (middle, end, -1, -1, 0.0)]
    return order, np.array(nodes, _NODE)


def search(vectors: np.ndarray, ids: np.ndarray, nodes: np.ndarray, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest of each query, ties to the smaller id, and how many points
    it was compared with; inf where fewer.  ``vectors`` and ``ids`` are in the tree's order; what is
    farther than ``bound`` need not be found."""
    best = np.full((len(queries), k), np.inf)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    seen = np.zeros(len(queries), np.int64)
    squares, query_squares = (vectors**2).sum(1), (queries**2).sum(1)

    def limit(who: np.ndarray) -> np.ndarray:
        return np.minimum(best[who, -1], bound[who])

    def look(who: np.ndarray, start: int, end: int) -> None:
        """Offer the points from ``start`` to ``end``: products rule most out, the rest are measured."""
        seen[who] += end - start
        size = query_squares[who][:, None] + squares[start:end]
        near = size - 2 * (queries[who] @ vectors[start:end].T) <= (limit(who) ** 2)[:, None] + 1e-9 * size
        i, j = np.nonzero(near)
        other = ids[start + j] != own[who[i]]
        i, j = i[other], j[other]
        if not len(i):
            return
        away = np.sqrt(((queries[who[i]] - vectors[start + j]) ** 2).sum(1))
        rows, place = np.unique(i, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(rows)), k), place])
        d = np.concatenate([best[who[rows]].ravel(), away])
        n = np.concatenate([found[who[rows]].ravel(), ids[start + j]])
        order = np.lexsort((n, d, row))
        first = np.searchsorted(row[order], np.arange(len(rows)))
        order = order[(first[:, None] + np.arange(k)).ravel()]  # each row has k or more
        best[who[rows]], found[who[rows]] = d[order].reshape(-1, k), n[order].reshape(-1, k)

    def visit(node: int, who: np.ndarray) -> None:
        start, end, near, far, radius = nodes[node].item()
        if near < 0:
            look(who, start, end)
            return
        look(who, start, start + 1)
        away = np.sqrt(((queries[who] - vectors[start]) ** 2).sum(1))
        inside = away < radius
        for mine, first, second in ((inside, near, far), (~inside, far, near)):
            if mine.any():
                visit(first, who[mine])
                more = np.abs(away[mine] - radius) <= factor * limit(who[mine])
                if more.any():
                    visit(second, who[mine][more])

    if len(queries) and len(vectors):
        visit(0, np.arange(len(queries)))
    return best, found, seen


def usable(df: DataFrame) -> DataFrame:
    """vec_id, dim and vector (doubles) of rows with an id and a vector of finite numbers, not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    df = df.where("vec_id is not null and embedding is not null").where(~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))
    return df.withColumn("dim", F.size("embedding"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a column of binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


@dataclass
class Cells:
    """Of one length of vectors: vantage points, and each cell's rings and number of shards."""

    pivots: np.ndarray
    low: np.ndarray  # cells x (own vantage point, then the first RINGS)
    high: np.ndarray
    shards: np.ndarray

    def away(self, vectors: np.ndarray) -> np.ndarray:
        """Distances from every vantage point."""
        return np.stack([np.sqrt(((vectors - p) ** 2).sum(1)) for p in self.pivots], 1)

    def gaps(self, away: np.ndarray) -> np.ndarray:
        """How far, at least, each cell is from each query."""
        out = np.maximum(self.low[:, 0] - away, away - self.high[:, 0])
        for r in range(self.low.shape[1] - 1):
            one = away[:, r : r + 1]
            out = np.maximum(out, np.maximum(self.low[:, r + 1] - one, one - self.high[:, r + 1]))
        return out.clip(0)


@dataclass
class Index:
    """Shards in the shared folder; the vantage points and rings, bounded by ``PIVOTS``, at hand."""

    shards: DataFrame
    cells: dict[int, Cells]


def _to_binary(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("embedding")
        flat, ends = lists.flatten().to_numpy(), np.cumsum(batch.column("dim").to_numpy(), dtype=np.int64)
        raw = [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("dim"), pa.array(raw, pa.binary())], ["vec_id", "dim", "vector"])


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    t = pa.Table.from_batches([batch])
    dims = t["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        part = t.filter(pa.array(dims == dim))
        for at in range(0, part.num_rows, TOGETHER):
            some = part.slice(at, TOGETHER)
            yield dim, some, _matrix(some["vector"], dim)


def _assign(batches, pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Cell and distances from its vantage point and the first few of each vector."""
    for batch in batches:
        for dim, t, v in _by_dim(batch):
            cells = Cells(pivots.get(dim, np.zeros((1, dim))), *[np.zeros((0, 0))] * 3)
            away = cells.away(v)
            cell = np.argmin(away, 1)
            kept = np.concatenate([away[np.arange(len(v)), cell][:, None], away[:, :RINGS]], 1)
            yield pa.RecordBatch.from_arrays([t["vec_id"].combine_chunks(), t["dim"].combine_chunks(), pa.array(cell.astype(np.int32)), t["vector"].combine_chunks(), pa.array(list(kept), pa.list_(pa.float64()))], ["vec_id", "dim", "cell", "vector", "away"])


def _build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    dim, cell, sub = (x.as_py() for x in key)
    t = t.sort_by([("vec_id", "ascending"), ("vector", "ascending")])
    vectors, ids = _matrix(t["vector"], dim), t["vec_id"].to_numpy()
    order, nodes = build(vectors)
    row = {"dim": dim, "cell": cell, "sub": sub, "n": len(ids), "ids": ids[order].tobytes(), "vectors": vectors[order].tobytes(), "nodes": nodes.tobytes()}
    return pa.Table.from_pylist([row], pa.schema([*[(c, pa.int32()) for c in ("dim", "cell", "sub", "n")], *[(c, pa.binary()) for c in ("ids", "vectors", "nodes")]]))


def _tie() -> Column:
    return F.xxhash64("vec_id", "vector")


def _few(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """dim, vec_id, tie and wanted of the vectors whose hash is so low that some three times as many as
    are wanted, and some dozens more, pass: a filter where the rows are, before anything is sorted."""
    low = (_tie() / float(1 << 63) + 1) / 2 < (3 * F.col("wanted") + 60) / F.col("n")
    return rows.join(F.broadcast(counts) if counts.count() <= LENGTHS else counts, "dim").where(low).select("dim", "vec_id", _tie().alias("tie"), "wanted").distinct()


def _lowest(rows: DataFrame, shard: int, pivots: int) -> DataFrame:
    """As many vantage points of each length as it has shards, by the smallest hashes, with their turn."""
    counts = rows.groupBy("dim").agg(F.count("*").alias("n")).withColumn("wanted", F.least(F.ceil(F.col("n") / shard), F.lit(pivots)))
    turn = F.row_number().over(Window.partitionBy("dim").orderBy("tie", "vec_id"))
    return _few(rows, common.stage(counts, "lengths")).withColumn("turn", turn).where("turn <= wanted")


def build_index(df: DataFrame, shard: int = SHARD, pivots: int = PIVOTS) -> Index:
    """Shards of the vectors with their trees, written to the shared folder.

    There is a vantage point for every ``shard`` vectors, ``pivots`` at most: those of the smallest
    hashes.  Every vector of :func:`usable` is indexed; lengths of vectors are apart from each other.
    """
    rows = common.stage(common.map_batches(usable(df), _to_binary, ROW), "vectors")
    sample = _lowest(rows, shard, pivots)
    sample = sample.orderBy("turn", "dim").limit(pivots)  # a bound also for a table of many lengths
    chosen = rows.join(F.broadcast(sample.select("dim", "vec_id", "tie", "turn")), ["dim", "vec_id"]).where(F.col("tie") == _tie()).groupBy("dim", "turn").agg(F.min("vector").alias("vector")).collect()
    points: dict[int, list] = {}
    for r in sorted(chosen, key=lambda r: (r["dim"], r["turn"])):
        points.setdefault(r["dim"], []).append(np.frombuffer(r["vector"], np.float64))
    known = {dim: np.stack(p) for dim, p in points.items()}

    held = common.stage(common.map_batches(rows, lambda b: _assign(b, known), ASSIGNED), "cells")
    places = [F.get("away", F.lit(i)) for i in range(RINGS + 1)]
    rings = held.groupBy("dim", "cell").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(places) for f in (F.min, F.max)])
    # lengths without a vantage point have one cell each, and no rings: they are searched whole
    cells = {dim: Cells(p, np.full((len(p), 1 + min(RINGS, len(p))), np.inf), np.full((len(p), 1 + min(RINGS, len(p))), -np.inf), np.ones(len(p), np.int64)) for dim, p in known.items()}
    sizes = []
    for r in rings.where(F.col("dim").isin(list(known))).collect():  # a row for each vantage point at most
        c = cells[r["dim"]]
        sizes.append((r["dim"], r["cell"], -(-r["n"] // shard)))
        c.shards[r["cell"]] = -(-r["n"] // shard)
        for i in range(c.low.shape[1]):
            c.low[r["cell"], i], c.high[r["cell"], i] = r[f"min{i}"], r[f"max{i}"]
    subs = df.sparkSession.createDataFrame(sizes, "dim int, cell int, subs long")
    shards = held.select("vec_id", "dim", "cell", "vector").join(F.broadcast(subs), ["dim", "cell"], "left")
    # dealt in turn, so that equal vectors do not meet in one shard; the rows are read from files in the same order each time
    shards = shards.withColumn("sub", F.pmod(F.monotonically_increasing_id(), F.coalesce("subs", F.lit(1))).cast("int")).drop("subs")
    return Index(common.stage(shards.groupBy("dim", "cell", "sub").applyInArrow(_build, SHARDS), "vptree"), cells)


ASKED = "dim int, cell int, sub int, query_id long, bound double, vector binary"


def _home(batches, cells: dict[int, Cells]) -> Iterator[pa.RecordBatch]:
    """One shard of each query's own cell."""
    for batch in batches:
        for dim, t, v in _by_dim(batch):
            c = cells.get(dim)
            ids = t["vec_id"].to_numpy()
            cell = np.argmin(c.away(v), 1) if c else np.zeros(len(v), np.int64)
            sub = ids % c.shards[cell] if c else np.zeros(len(v), np.int64)
            yield _asked(dim, cell, sub, ids, np.full(len(v), np.inf), t["vector"].combine_chunks())


def _reached(batches, cells: dict[int, Cells], factor: float) -> Iterator[pa.RecordBatch]:
    """Every other shard that a query's radius reaches."""
    for batch in batches:
        for dim, t, v in _by_dim(batch):
            if (c := cells.get(dim)) is None:
                continue
            ids, bound = t["vec_id"].to_numpy(), t["bound"].to_numpy()
            away = c.away(v)
            home = np.argmin(away, 1)
            for at in range(int(c.shards.max())):
                row, cell = np.nonzero((c.gaps(away) <= factor * bound[:, None]) & (at < c.shards))
                other = (cell != home[row]) | (at != ids[row] % c.shards[cell])
                row, cell = row[other], cell[other]
                if len(row):
                    yield _asked(dim, cell, np.full(len(row), at), ids[row], bound[row], t["vector"].combine_chunks().take(pa.array(row)))


def _asked(dim: int, cell: np.ndarray, sub: np.ndarray, ids: np.ndarray, bound: np.ndarray, vectors: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(ids), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(sub.astype(np.int32)), pa.array(ids), pa.array(bound), vectors]
    return pa.RecordBatch.from_arrays(columns, ["dim", "cell", "sub", "query_id", "bound", "vector"])


def _answer(batches, k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """The best of each query in its shard: a shard's row comes first, then its queries."""
    tree, key = None, None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        keys = np.stack([t[c].to_numpy() for c in ("dim", "cell", "sub")], 1)
        heads = np.flatnonzero(t["nodes"].is_valid().to_numpy())
        for a, b in zip(sorted({0, *heads.tolist()}), [*heads[heads > 0].tolist(), len(keys)], strict=True):
            if a in heads:
                r = t.slice(a, 1).to_pylist()[0]
                tree = np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"]), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["nodes"], _NODE)
                key, a = keys[a], a + 1
            if key is None:
                continue
            mine = np.flatnonzero((keys[a:b] == key).all(1)) + a  # a shard that has no row has no vectors
            for at in range(0, len(mine), TOGETHER):
                some = t.take(pa.array(mine[at : at + TOGETHER]))
                own = some["query_id"].to_numpy()
                best, found, _ = search(*tree, _matrix(some["vector"], int(key[0])), own, some["bound"].to_numpy(), k, factor)
                full = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)[full.ravel()]), pa.array(found[full]), pa.array(best[full])], ["query_id", "vec_id", "score"])


def _meet(index: Index, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """Queries and the shards that they ask, one task a shard."""
    shards = index.shards.select("dim", "cell", "sub", F.lit(0).alias("turn"), *[F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("bound", "double"), ("vector", "binary"))], "ids", "vectors", "nodes")
    asked = asked.select("dim", "cell", "sub", F.lit(1).alias("turn"), "query_id", "bound", "vector", *[F.lit(None).cast("binary").alias(c) for c in ("ids", "vectors", "nodes")])
    tasks = min(int(index.shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, sum(int(c.shards.sum()) for c in index.cells.values())))
    both = shards.union(asked).repartition(tasks, "dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", "turn", "query_id")
    return common.map_batches(both, lambda b: _answer(b, k, factor), "query_id long, vec_id long, score double")


def nearest(index: Index, queries: DataFrame, k: int = 10, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, nearest first.

    Nearness is Euclidean distance in double precision, ties to the smaller vec_id; candidates are
    all vectors of the query's length but those with its own vec_id.  Null, zero or not finite
    vectors take no part; of queries that share a vec_id the least vector counts.  Fewer than k
    candidates are all returned; an empty table gives no rows; other columns are ignored.
    """
    rows = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    rows = common.stage(common.map_batches(rows, _to_binary, ROW), "queries")
    cells = index.cells
    home = common.stage(_meet(index, common.map_batches(rows, lambda b: _home(b, cells), ASKED), k, factor), "home")
    radius = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("bound"))
    rows = rows.join(radius, rows["vec_id"] == radius["query_id"], "left").select("vec_id", "dim", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    away = _meet(index, common.map_batches(rows, lambda b: _reached(b, cells, factor), ASKED), k, factor)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return home.union(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
