"""Approximate nearest neighbours by inner product through a permutation index.

A bounded sample of vectors serves as pivots.  Each vector is represented by its nearest pivots in order and posted, with
its place in that order, in the inverted file of each of them; places beyond NEAR are not posted.  A query reads the
inverted files of its own nearest pivots alone, ranks what stands there by the footrule distance of the orders (a pivot
that one order lacks counts as place NEAR), and ranks the best again by the inner product of the original vectors.

Vectors of different length are first made comparable by angle: a vector gets one more component, so that all have the
length of the longest; a query gets zero there.  This leaves the order of inner products as it is.

Vectors lie in cells around the first pivots, and cells in shards of a bounded size.  A directory (one bitmap for each of
at most MOST_CELLS cells) says which pivots have posts in a cell; a query goes only to the cells where SHARED of its
pivots have some, and a shard is copied once for each BLOCK queries that come to it.  On vectors that form clusters this
keeps a query away from most of them; on vectors without any structure every cell has posts of every pivot.  Equal vectors
of a shard share one entry, so a common vector cannot crowd out the others, and a cell of any size is split by ids.

Defined results: null, zero or non-finite vectors, vectors with null components or without id, and vectors of another
dimension than the commonest take no part; rows of one id count once (with their smallest vector); ties go to the
smaller id; fewer candidates than asked for give all; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.sources.shipping import ship

#: Vectors that are sampled to fit the pivots (the bound of all that the driver collects), and pivots.
SAMPLE, PIVOTS = 4096, 4096
#: Length of an order: the inverted files that a vector is posted in and that a query reads.
NEAR = 82
#: Candidates that are ranked again: this share of a shard, LEAST at least, and all whose orders agree with the query's
#: to this part of what equal orders do (so that the edge of the share does not cut through a dense cluster).
SHARE, LEAST, DENSE = 0.1, 256, 0.15
#: Pivots that a query must share with a cell, cells at most, vectors of a shard, queries that share a copy of it.
SHARED, MOST_CELLS, SHARD, BLOCK = 3, 1024, 16_384, 8192
#: Bits of a bitmap as Spark's bitmap functions have them.
_BITS = 32_768


def sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, one for each id."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))
    return kept.groupBy("vec_id").agg(F.min("v").alias("v"))


def choose_pivots(vectors: DataFrame, seed: int = 7) -> tuple[np.ndarray, float] | None:
    """Pivots (with the component that evens lengths) from a bounded sample, and the largest length of all vectors."""
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"))
    if not (best := sizes.orderBy(F.desc("n"), "d").limit(1).collect()):
        return None
    sample = vectors.filter(F.size("v") == best[0]["d"]).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).collect()
    length = float(np.sqrt(best[0]["top"]))
    x = np.unique(np.array([row["v"] for row in sample]), axis=0)
    order = np.random.default_rng(seed).permutation(len(x))[:PIVOTS]
    return evened(x[order], length), length


def evened(x: np.ndarray, length: float) -> np.ndarray:
    x = x / length
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))[:, None]])


def levelled(q: np.ndarray) -> np.ndarray:
    return np.hstack([q / np.sqrt((q * q).sum(axis=1))[:, None], np.zeros((len(q), 1))])


def orders(x: np.ndarray, pivots: np.ndarray, near: int, cells: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x``, its ``near`` nearest pivots by nearness, and the nearest of the first ``cells`` pivots."""
    out, cell = np.empty((len(x), near), "<u2"), np.empty(len(x), np.int32)
    pivots = pivots.astype(np.float32).T
    for at in range(0, len(x), 512):
        far = -(x[at : at + 512].astype(np.float32) @ pivots)
        cell[at : at + 512] = far[:, :cells].argmin(axis=1)
        own = np.sort(np.argpartition(far, near - 1, axis=1)[:, :near], axis=1) if near < far.shape[1] else np.tile(np.arange(near), (len(far), 1))
        out[at : at + 512] = np.take_along_axis(own, np.argsort(np.take_along_axis(far, own, 1), axis=1, kind="stable"), 1)
    return out, cell


class Shard:
    """Inverted files of the pivots over the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, order: np.ndarray, pivots: int):
        by_id = np.argsort(ids, kind="stable")
        ids, x, order = ids[by_id], x[by_id], order[by_id]
        _, first, entry = np.unique(x, axis=0, return_index=True, return_inverse=True)
        number = np.argsort(np.argsort(first))  # entries by their smallest id
        entry = number[entry.ravel()]
        first = np.sort(first)
        self.x, order = x[first], order[first]
        #: The entries in single precision, none longer than 1.
        self.length = float(np.sqrt((self.x * self.x).sum(axis=1).max()))
        self.single = (self.x / (self.length or 1.0)).astype(np.float32)
        members = np.argsort(entry, kind="stable")
        self.ids, self.starts = ids[members], np.searchsorted(entry[members], np.arange(len(self.x) + 1))
        self.near = order.shape[1]
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        #: Posts by pivot: the entry, and NEAR less the place that it gives the pivot.
        self.entries, self.worth = by_pivot // self.near, (self.near - by_pivot % self.near).astype(float)
        self.lists = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """For each entry, half of what the footrule distance to ``order`` lies below that of orders without a common pivot."""
        begin, end = self.lists[order], self.lists[order.astype(np.int64) + 1]
        lists = list(zip(begin.tolist(), end.tolist(), strict=True))
        entries = np.concatenate([self.entries[a:b] for a, b in lists])
        worth = np.minimum(np.concatenate([self.worth[a:b] for a, b in lists]), np.repeat(np.arange(self.near, 0.0, -1.0), end - begin))
        return np.bincount(entries, worth, len(self.x))

    def search(self, q: np.ndarray, order: np.ndarray, own: int, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.x)
        most = min(n, max(LEAST, int(share * n)))
        if most < n:
            near = self.agreement(order).astype(np.int64)
            # Entries by agreement, counted from the highest: the one at which MOST are reached is the edge.
            edge = len(counts := np.bincount(near)) - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), most))
            edge = min(edge, DENSE * self.near * (self.near + 1) / 2)
            # Ties of the edge are all taken; entries without a common pivot only as far as they are needed.
            best = np.flatnonzero(near >= edge) if edge > 0 else np.union1d(np.flatnonzero(near), np.arange(min(n, LEAST)))
        else:
            best = np.arange(n)
        size = float(np.sqrt((q * q).sum()))
        if len(best) > k + 1 and 0 < size < np.inf and 0 < self.length < np.inf:
            # In single precision first: what lies further below the k + 1st than rounding explains is not among the nearest.
            rough = self.single[best] @ (q / size).astype(np.float32)
            best = best[rough >= np.partition(rough, -k - 1)[-k - 1] - np.float32(4e-7 * (len(q) + 4))]
        score = (self.x[best] * q).sum(axis=1)
        top = np.lexsort((best, -score))[: k + 1]
        # An entry's k + 1 smallest ids hold all of it that can be among the nearest.
        ids = [self.ids[self.starts[e] : min(self.starts[e + 1], self.starts[e] + k + 1)] for e in best[top]]
        score = np.repeat(score[top], [len(x) for x in ids])
        ids = np.concatenate(ids)
        kept = ids != own
        ids, score = ids[kept], score[kept]
        final = np.lexsort((ids, -score))[:k]
        return ids[final], score[final]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` among ``vectors``, both of :func:`sound`."""
    spark = vectors.sparkSession
    ship(spark)
    fitted = choose_pivots(vectors)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots, length = fitted
    d, near = pivots.shape[1] - 1, min(NEAR, len(pivots))
    vectors, queries = vectors.filter(F.size("v") == d), queries.filter(F.size("v") == d)
    cells = max(1, min(MOST_CELLS, len(pivots), -(-vectors.count() // SHARD)))
    shared = spark.sparkContext.broadcast((pivots, length))  # PIVOTS vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, length = shared.value
        for batch in batches:
            if batch.num_rows:
                order, cell = orders(evened(_matrix(batch.column("v")), length), pivots, near, cells)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in order], pa.binary()), pa.array(cell)], ["vec_id", "v", "posts", "cell"])

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, cell = np.frombuffer(b"".join(batch.column("posts").to_pylist()), "<u2").reshape(-1, near), batch.column("cell").to_numpy()
            own = np.unique(cell)
            bits = np.zeros((len(own), _BITS), np.uint8)
            bits[np.searchsorted(own, cell)[:, None], order] = 1
            packed = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(np.searchsorted(own, cell), minlength=len(own)).astype(np.int64)), pa.array([x.tobytes() for x in packed], pa.binary())], ["cell", "n", "bits"])

    posted = cut(vectors.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<double>, posts binary, cell int"))
    directory = posted.select("posts", "cell").mapInArrow(used, "cell int, n long, bits binary").groupBy("cell").agg(F.sum("n").alias("n"), F.bitmap_or_agg("bits").alias("bits")).orderBy("cell").collect()  # MOST_CELLS rows
    numbers = np.array([row["cell"] for row in directory], np.int32)
    known = np.unpackbits(np.frombuffer(b"".join(bytes(row["bits"]) for row in directory), np.uint8).reshape(len(directory), -1), axis=1, bitorder="little")[:, : len(pivots)].astype(bool)
    guide = spark.sparkContext.broadcast((numbers, known))  # MOST_CELLS x PIVOTS bits

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, _ = shared.value
        numbers, known = guide.value
        for batch in batches:
            if batch.num_rows:
                order, _ = orders(levelled(_matrix(batch.column("v"))), pivots, near)
                goes = [numbers[known[:, x].sum(axis=1) >= min(SHARED, near)] for x in order]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in order], pa.binary()), pa.array(goes, pa.list_(pa.int32()))], ["query_id", "v", "reads", "cells"])

    asked = cut(queries.select(F.col("vec_id").alias("query_id"), "v").mapInArrow(route, "query_id long, v array<double>, reads binary, cells array<int>"))
    visits = {row["cell"]: row["n"] for row in asked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MOST_CELLS rows
    plan = spark.createDataFrame([(row["cell"], -(-row["n"] // SHARD), -(-visits[row["cell"]] // BLOCK)) for row in directory if row["cell"] in visits], "cell int, shards int, blocks int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda key, n, seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.col(n)).cast("int")
    plan = F.broadcast(plan)  # MOST_CELLS rows
    left = posted.join(plan, "cell").select("vec_id", "v", "posts", "cell", mine("vec_id", "shards", 0).alias("shard"), upto("blocks").alias("block"))
    right = asked.withColumn("cell", F.explode("cells")).join(plan, "cell").select("query_id", "v", "reads", "cell", upto("shards").alias("shard"), mine("query_id", "blocks", 1).alias("block"))
    n_pivots = len(pivots)

    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            as_orders = lambda column: np.frombuffer(b"".join(column), "<u2").reshape(-1, near)
            shard = Shard(index["vec_id"].to_numpy(), np.stack(index["v"].to_numpy()), as_orders(index["posts"]), n_pivots)
            for own, vector, order in zip(queries["query_id"].tolist(), np.stack(queries["v"].to_numpy()), as_orders(queries["reads"]), strict=True):
                ids, score = shard.search(vector, order, own, k, share)
                out.append((np.full(len(ids), own), ids, score))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    group = ("cell", "shard", "block")
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut(sound(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20, SHARE)
