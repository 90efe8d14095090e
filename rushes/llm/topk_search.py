"""Exact top-k search by inner product: exhaustive, one query component after the other.

Inside a cell the candidates are inverted: each component has its postings, the positions and weights of the candidates
in which it isn't zero.  The queries of a batch are sparse rows; component by component, those that have it scatter its
postings, times their own weight, into dense score arrays over the cell's candidates.  A partition selection takes the
first k of every array, and the cells' selections are merged by a ranked window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushes.llm.vector_cells import best, dealt, exact_type, id_array, ids, matrix, top, usable, widest

#: Dense score arrays that a batch of queries fills.
_ARRAYS = 16


def postings(candidates: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Positions and weights of each component; a list that holds over a quarter of the candidates is stored without positions."""
    out = []
    for column in candidates.T:
        at = np.flatnonzero(column)
        out.append((None, np.ascontiguousarray(column)) if 4 * len(at) > len(column) else (at, column[at]))
    return out


def accumulate(queries: np.ndarray, lists: list, scores: np.ndarray) -> None:
    """Add every query's inner products into its row of ``scores``."""
    part = np.empty_like(scores)
    for weights, (at, values) in zip(queries.T, lists, strict=True):
        rows = np.flatnonzero(weights)
        if not len(rows) or not len(values):
            continue
        if at is None and 2 * len(rows) > len(scores):
            scores += np.multiply(weights[:, None], values[None, :], out=part)
        elif at is None:
            scores[rows] += weights[rows, None] * values[None, :]
        else:
            for i in rows:
                scores[i][at] += weights[i] * values


def _cell(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        width = widest(queries, candidates)
        own, found = ids(candidates["id"]), []
        order = np.argsort(own, kind="stable")  # so that of equal scores the first position has the smallest id
        own = own[order]
        c, q = matrix(candidates["v"], width)[order], matrix(queries["v"], width)
        kind = exact_type(q, c)
        lists, q, asks = postings(c.astype(kind)), q.astype(kind), ids(queries["id"])
        for a in range(0, len(q) if len(c) else 0, _ARRAYS):
            scores = np.zeros((min(_ARRAYS, len(q) - a), len(c)), kind)
            accumulate(q[a : a + _ARRAYS], lists, scores)
            for i, row in enumerate(scores, a):
                lo, hi = np.searchsorted(own, asks[i], "left"), np.searchsorted(own, asks[i], "right")
                at = top(np.concatenate([row[:lo], row[hi:]]) if hi > lo else row, k)
                at = at + (hi - lo) * (at >= lo)
                found.append((np.full(len(at), i), at, row[at].astype(np.int64)))
        i, at, s = (np.concatenate(x).astype(np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"q": queries["q"].take(pa.array(i)), "query_id": queries["id"].take(pa.array(i)), "vec_id": id_array(own[at]), "score": pa.array(s)})

    return run


def exact_top_k(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of floor(256 x) for every row that ``is_query``.

    Candidates are all rows but those with the query's own id; ties go to the smaller id, rows without an id come last and
    are never queries.  Vectors that are null or hold null or non-finite components take no part; a shorter vector counts
    as filled up with zeros, so an empty one scores 0.  Repeated candidates take a rank each, repeated queries (same id
    and vector) are asked once, and queries that share only their id have their own lists.  Fewer than ``k`` candidates
    give fewer rows, an empty table none.  Other columns are not read.  Scores beyond 64 bits are an error.
    """
    named = rows.where(usable(vector)).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    asked = named.where(F.col("asks") & F.col("id").isNotNull()).select("id", "v").distinct()
    queries, candidates = dealt(asked.select(F.xxhash64("id", "v").alias("q"), "id", "v"), named.select("id", "v"))
    found = queries.groupBy("_x", "_y").cogroup(candidates.groupBy("_x", "_y")).applyInArrow(_cell(k), "q long, query_id long, vec_id long, score long")
    return best(found, k, ["query_id", "q"], "score", "vec_id", "rank").select("query_id", "rank", "vec_id", "score")
