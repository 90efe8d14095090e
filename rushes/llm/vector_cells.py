"""Integer vectors dealt into cells of bounded size: a block of queries against a block of candidates.

Every pair of a query and a candidate meets in one cell.  A cell's rows follow from byte budgets and the vectors' length,
whatever the table; blocks are dealt by position, so a vector or id that makes up much of the table fills no block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BYTES, CANDIDATE_BYTES = 32 << 20, 8 << 20
#: Stands for a null id inside a task, where it orders last.
NO_ID = np.iinfo(np.int64).max
#: Below every score.
NEVER = np.iinfo(np.int64).min


def usable(vector: str) -> Column:
    """Vectors that aren't null and hold neither nulls nor NaN nor infinities."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def dealt(queries: DataFrame, candidates: DataFrame, vector: str = "v") -> tuple[DataFrame, DataFrame]:
    """Both tables with ``_x`` and ``_y``: the block of the candidate, the block of the query.

    Each query comes once in every block of candidates and the other way round.  Candidates are dealt by their position in
    the table, which a task that runs again reads in the same order; queries, which are distinct, by their hash.
    """
    spark = candidates.sparkSession
    sizes = [df.agg(F.count("*"), F.max(F.size(vector))).first() for df in (queries, candidates)]
    width = 8 * max([1, *(s[1] or 0 for s in sizes)])
    most = max(256, CANDIDATE_BYTES // width)
    # Smaller blocks while they would leave cores idle.
    rows = min(most, max(1024, -(-sizes[1][0] // (3 * spark.sparkContext.defaultParallelism))))
    nx, ny = max(1, -(-sizes[1][0] // rows)), max(1, -(-sizes[0][0] // max(256, QUERY_BYTES // width)))
    at = lambda key, n: F.pmod(key, F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return (
        queries.withColumn("_y", at(F.xxhash64("q"), ny)).withColumn("_x", every(nx)),
        candidates.withColumn("_x", at(F.monotonically_increasing_id(), nx)).withColumn("_y", every(ny)),
    )


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(256 x) of a list column as integers, one row each; components that a shorter vector lacks are 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256)
    if len(values) and np.abs(values).max() >= 2.0**62:
        raise ArithmeticError("components of 2^54 or more have no exact integer score")
    out = np.zeros((len(lists), width), np.int64)
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(values)) - np.repeat(starts, sizes)] = values
    return out


def widest(*tables: pa.Table) -> int:
    return max([0, *(pc.max(pc.list_value_length(t["v"])).as_py() or 0 for t in tables)])


def ids(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, int(NO_ID)).to_numpy()


def id_array(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def exact_type(a: np.ndarray, b: np.ndarray):
    """The narrowest integers that hold every inner product of the rows of ``a`` and ``b`` exactly."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound >= 1 << 63:
        raise ArithmeticError("scores beyond 64 bits")
    return np.int32 if bound < 1 << 31 else np.int64


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, of equal ones the first; in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def best(df: DataFrame, k: int, keys: list[str], score: str, tie: str, rank: str) -> DataFrame:
    """The ``k`` first rows of each key; each task passes on no more than that many."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(tie))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)
