"""Comparing every vector of a large table with every vector of a small one.

The small side is measured first.  Up to ``BROADCAST_BYTES`` it is shipped to the tasks as one matrix; above
that both sides are cut into blocks and cells of ``rows x rows`` are compared in separate tasks.  Only
the best matches leave a task; no pair table exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 20_000
#: What the scores of one product may take, whatever the number of vectors on either side.
SCORE_BYTES = 32 * 1024 * 1024


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length one; a zero vector becomes NaN and matches nothing."""
    m = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _small_is_broadcastable(small: DataFrame, limit: int) -> bool:
    size = small.agg(
        F.sum(F.size("embedding").cast("long") * 8 + 64).alias("bytes")
    ).first()["bytes"]
    return (size or 0) <= limit


def _rows(df: DataFrame, id_col: str, name: str) -> DataFrame:
    present = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return df.filter(present).select(F.col(id_col).alias(name), "embedding")


def _cells(big: DataFrame, small: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Key both sides by (big shard, small block); each cell holds about ``block_rows`` rows of either side."""
    n_big = max(1, -(-big.count() // block_rows))
    n_small = max(1, -(-small.count() // block_rows))
    b = big.withColumn("_x", F.pmod(F.xxhash64("big_id"), F.lit(n_big).cast("long"))).withColumn(
        "_y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_small - 1).cast("long")))
    )
    s = small.withColumn("_y", F.pmod(F.xxhash64("small_id"), F.lit(n_small).cast("long"))).withColumn(
        "_x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_big - 1).cast("long")))
    )
    return b, s


def nearest_of(
    big: DataFrame,
    small: DataFrame,
    big_id: str,
    small_id: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each row of ``big`` the most similar row of ``small``: ``big_id``, ``small_id``, ``similarity`` (cosine).

    Ties go to the lowest ``small_id``.  Rows without an embedding on either side are ignored.
    """
    b, s = _rows(big, big_id, "big_id"), _rows(small, small_id, "small_id")
    types = {f.name: f.dataType for f in [*b.schema.fields, *s.schema.fields]}
    schema = T.StructType(
        [
            T.StructField("big_id", types["big_id"]),
            T.StructField("small_id", types["small_id"]),
            T.StructField("similarity", T.DoubleType()),
        ]
    )

    def best(ids: pd.Series, m: np.ndarray, other: np.ndarray, other_ids: np.ndarray) -> pd.DataFrame:
        at, top = np.zeros(len(m), "int64"), np.full(len(m), -np.inf)
        step = max(1, SCORE_BYTES // (8 * max(1, len(other))))
        for i in range(0, len(m) if len(other) else 0, step):
            scores = m[i : i + step] @ other.T
            scores[np.isnan(scores)] = -np.inf
            at[i : i + step] = scores.argmax(axis=1)
            top[i : i + step] = scores.max(axis=1)
        out = pd.DataFrame({"big_id": ids.to_numpy(), "small_id": other_ids[at] if len(other) else other_ids[:0], "similarity": top})
        return out[np.isfinite(top)]

    if _small_is_broadcastable(s, broadcast_bytes):
        local = s.toPandas().sort_values("small_id")
        if local.empty:
            return big.sparkSession.createDataFrame([], schema).toDF(big_id, small_id, "similarity")
        shared = big.sparkSession.sparkContext.broadcast((unit_rows(local["embedding"]), local["small_id"].to_numpy()))

        def per_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            other, other_ids = shared.value
            for pdf in frames:
                if len(pdf):
                    yield best(pdf["big_id"], unit_rows(pdf["embedding"]), other, other_ids)

        return b.mapInPandas(per_batch, schema).toDF(big_id, small_id, "similarity")

    cb, cs = _cells(b, s, block_rows)

    def per_cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["big_id", "small_id", "similarity"])
        right = right.sort_values("small_id")
        return best(left["big_id"], unit_rows(left["embedding"]), unit_rows(right["embedding"]), right["small_id"].to_numpy())

    partial = cb.groupBy("_x", "_y").cogroup(cs.groupBy("_x", "_y")).applyInPandas(per_cell, schema)
    winner = F.min_by(F.struct("small_id", "similarity"), F.struct((-F.col("similarity")), F.col("small_id")))
    return partial.groupBy("big_id").agg(winner.alias("w")).select("big_id", "w.*").toDF(big_id, small_id, "similarity")


class TopK:
    """The ``k`` best vectors of each query so far, as arrays; products are made in tiles of at most ``budget`` bytes.

    The vectors of a batch are dealt to the nearest of some pivots among them.  By the triangle inequality no vector of a
    pivot's block is nearer to a query than the pivot less the block's radius, so a block is skipped for every query whose
    k-th best is better than that.  The result is that of all products; ``products`` of ``pairs`` were made.
    """

    def __init__(self, queries: np.ndarray, k: int, budget: int = SCORE_BYTES, pivots: int = 32):
        self.queries, self.k, self.budget, self.pivots = np.nan_to_num(queries, nan=0.0), k, budget, pivots
        self.valid = ~np.isnan(queries).any(axis=1) if len(queries) else np.zeros(0, bool)
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids: np.ndarray | None = None
        self.products = self.pairs = 0

    def _blocks(self, m: np.ndarray):
        """Row numbers of each block, in order, and for each query the highest score that it can hold."""
        n = min(self.pivots, len(m) // 64)
        if n < 2 or len(self.queries) < 4 * n:
            yield np.arange(len(m)), np.full(len(self.queries), np.inf)
            return
        pivots = m[np.linspace(0, len(m) - 1, n).astype("int64")]
        nearest = np.empty(len(m), "int64")
        step = max(1, self.budget // (8 * n))
        for i in range(0, len(m), step):
            nearest[i : i + step] = (m[i : i + step] @ pivots.T).argmax(axis=1)
        for p in range(n):
            rows = np.flatnonzero(nearest == p)
            if len(rows):
                radius = np.sqrt(((m[rows] - pivots[p]) ** 2).sum(axis=1).max())
                away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.queries @ pivots[p])))
                yield rows, 1.0 - np.maximum(0.0, away - radius) ** 2 / 2 + 1e-9

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        there = ~np.isnan(m).any(axis=1)
        ids, m = ids[there], m[there]
        if ids.dtype == object:
            ids = ids.astype(str)
        self.ids = np.zeros(self.scores.shape, ids.dtype) if self.ids is None else self.ids.astype(np.promote_types(self.ids.dtype, ids.dtype))
        for rows, highest in self._blocks(m):
            open_ = np.flatnonzero(self.valid & (highest >= self.scores[:, -1]))
            self.pairs += len(rows) * len(self.queries)
            self.products += len(rows) * len(open_)
            step = max(1, self.budget // (8 * len(rows)))
            for i in range(0, len(open_), step):
                self._merge(open_[i : i + step], ids[rows], m[rows])

    def _merge(self, who: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
        scores = self.queries[who] @ m.T
        bar = self.scores[who, -1]
        if m.shape[0] > self.k:
            bar = np.maximum(bar, np.partition(scores, m.shape[0] - self.k, axis=1)[:, m.shape[0] - self.k])
        query, row = np.nonzero(scores >= bar[:, None])  # with all ties of the k-th, settled by id below
        held_q, held_at = np.nonzero(np.isfinite(self.scores[who]))
        q = np.concatenate([held_q, query])
        s = np.concatenate([self.scores[who][held_q, held_at], scores[query, row]])
        x = np.concatenate([self.ids[who][held_q, held_at], ids[row]])
        order = np.lexsort((x, -s, q))
        q, s, x = q[order], s[order], x[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.scores[who[q[keep]], place[keep]] = s[keep]
        self.ids[who[q[keep]], place[keep]] = x[keep]

    def rows(self, query_ids: np.ndarray) -> pd.DataFrame:
        query, at = np.nonzero(np.isfinite(self.scores))
        found = self.ids[query, at] if self.ids is not None else np.zeros(0, "int64")
        return pd.DataFrame({"small_id": query_ids[query], "big_id": found, "similarity": self.scores[query, at]})


def search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` most similar vectors per query by cosine, ranked from 1; ties go to the lowest vector id.

    Each task keeps its own ``k`` best per query over all its batches, so what is shuffled is
    ``tasks x queries x k`` rows however many vectors there are.
    """
    v, q = _rows(vectors, vector_id, "big_id"), _rows(queries, query_id, "small_id")
    types = {f.name: f.dataType for f in [*v.schema.fields, *q.schema.fields]}
    schema = T.StructType(
        [
            T.StructField("small_id", types["small_id"]),
            T.StructField("big_id", types["big_id"]),
            T.StructField("similarity", T.DoubleType()),
        ]
    )

    if _small_is_broadcastable(q, broadcast_bytes):
        local = q.toPandas().sort_values("small_id")
        matrix = unit_rows(local["embedding"]) if len(local) else np.zeros((0, 1))
        shared = vectors.sparkSession.sparkContext.broadcast((matrix, local["small_id"].to_numpy()))

        def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            other, other_ids = shared.value
            best = TopK(other, k)
            for pdf in frames:
                if len(pdf) and len(other_ids):
                    best.add(pdf["big_id"].to_numpy(), unit_rows(pdf["embedding"]))
            yield best.rows(other_ids)

        partial = v.mapInPandas(per_task, schema)
    else:
        cv, cq = _cells(v, q, block_rows)

        def per_cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame(columns=["small_id", "big_id", "similarity"])
            best = TopK(unit_rows(right["embedding"]), k)
            best.add(left["big_id"].to_numpy(), unit_rows(left["embedding"]))
            return best.rows(right["small_id"].to_numpy())

        partial = cv.groupBy("_x", "_y").cogroup(cq.groupBy("_x", "_y")).applyInPandas(per_cell, schema)

    w = Window.partitionBy("small_id").orderBy(F.desc("similarity"), "big_id")
    return (
        partial.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select(
            F.col("small_id").alias(query_id), F.col("big_id").alias(vector_id), "similarity",
            F.col("rank").cast("long").alias("rank"),
        )
    )


def zero_shot(frames: DataFrame, labels: DataFrame, frame_id: str = "frame_id", label: str = "label") -> DataFrame:
    """The label whose embedding is most similar to each frame.

    ``labels`` has ``label``, ``idx``, ``embedding``; ties go to the lowest ``idx``.  The softmax over
    similarities is monotone, so the winner needs no exponentials.
    """
    voted = nearest_of(frames, labels, frame_id, "idx")
    return voted.join(F.broadcast(labels.select("idx", label)), "idx", "left").drop("idx") if _few(labels) else (
        voted.join(labels.select("idx", label), "idx", "left").drop("idx")
    )


def _few(labels: DataFrame, limit: int = 100_000) -> bool:
    return labels.select("idx").limit(limit + 1).count() <= limit
