"""Hard negatives by disjoint score slots.

An anchor's positives each allow negatives in a window of scores below their own.  The windows overlap; their upper limits,
in order, cut the scores into disjoint slots.  Each task keeps, for every anchor and slot, only the first few negatives,
and so does the merge over tasks.  Walking the slots upwards from the lowest, a running merge holds the first negatives
under each upper limit, which answers every window: what lies under its lower limit is left out at the end, since the
first few under the upper limit are above it whenever enough are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushes.llm.common import written
from rushes.llm.vector_cells import NEVER, NO_ID, best, dealt, exact_type, id_array, ids, matrix, top, usable, widest

#: Of a positive's score: the share that a negative reaches at least and at most, in hundredths.
LOWEST, HIGHEST = 50, 95
_ANCHORS = 32


def _comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in doubles where all sums stay below 2^53, so that products are exact either way."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 1 << 53:
        return a.astype(np.float64), b.astype(np.float64)
    exact_type(a, b)
    return a, b


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T).astype(np.int64)


def _sorted(rows: pa.Table) -> pa.Table:
    """By id, those without one last: of equal scores the first position has the smallest id."""
    return rows.take(pa.array(np.argsort(ids(rows["id"]), kind="stable")))


def _same_label(k: int):
    """The first ``k`` rows of each anchor's label among the cell's rows."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows, width, found = _sorted(rows), widest(anchors, rows), []
        a, c = _comparable(matrix(anchors["v"], width), matrix(rows["v"], width))
        own, asks = ids(rows["id"]), ids(anchors["id"])
        mine, theirs = anchors["label"].to_numpy(), rows["label"].to_numpy()
        for label in np.unique(mine):
            at, who = np.flatnonzero(theirs == label), np.flatnonzero(mine == label)
            of_label = c[at]
            for part in np.array_split(who, -(-len(who) // _ANCHORS)):
                for i, scores in zip(part, _products(a[part], of_label), strict=True):
                    other = np.flatnonzero(own[at] != asks[i])
                    first = other[top(scores[other], k)]
                    found.append((np.full(len(first), i), at[first], scores[first]))
        i, at, s = (np.concatenate(x).astype(np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"q": anchors["q"].take(pa.array(i)), "anchor_id": anchors["id"].take(pa.array(i)), "positive_id": id_array(own[at]), "positive_score": pa.array(s)})

    return run


def _slots(k: int):
    """The first ``k`` negatives of each anchor and slot among the cell's rows; slot 0 is the lowest."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows, width, found = _sorted(rows), widest(anchors, rows), []
        a, c = _comparable(matrix(anchors["v"], width), matrix(rows["v"], width))
        own = ids(rows["id"])
        mine, theirs = anchors["label"].to_numpy(), rows["label"].to_numpy()
        limits, least = anchors["limits"].to_pylist(), anchors["least"].to_numpy()
        for start in range(0, len(a), _ANCHORS):
            for i, scores in enumerate(_products(a[start : start + _ANCHORS], c), start):
                upper = np.array(limits[i], np.int64)
                at = np.flatnonzero((scores >= least[i]) & (scores <= upper[-1]) & (theirs != mine[i]))
                slot = np.searchsorted(upper, scores[at])
                for j in np.unique(slot):
                    own_at = at[slot == j]
                    first = own_at[top(scores[own_at], k)]
                    found.append((np.full(len(first), i), np.full(len(first), j), first, scores[first]))
        i, j, at, s = (np.concatenate(x).astype(np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        return pa.table({"q": anchors["q"].take(pa.array(i)), "anchor_id": anchors["id"].take(pa.array(i)), "slot": pa.array(j.astype(np.int32)), "negative_id": id_array(own[at]), "negative_score": pa.array(s)})

    return run


def merged_upwards(scores: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the first negatives under each upper limit, from those of each slot: (anchors, slots, first few).

    ``NEVER`` where there are none.  Each step merges a slot into what lies under it.
    """
    n, slots, k = scores.shape
    out_s, out_n = np.empty_like(scores), np.empty_like(names)
    run_s, run_n = np.full((n, k), NEVER), np.full((n, k), NO_ID)
    for j in range(slots):
        s, m = np.concatenate([run_s, scores[:, j]], 1), np.concatenate([run_n, names[:, j]], 1)
        order = np.lexsort((m, -(s + 1)), axis=1)[:, :k]  # -(NEVER + 1) is the largest number
        run_s, run_n = np.take_along_axis(s, order, 1), np.take_along_axis(m, order, 1)
        out_s[:, j], out_n[:, j] = run_s, run_n
    return out_s, out_n


def _answer(k: int, names: list[str]):
    def run(batches):
        for b in batches:
            limits, positives, tops = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
            n, slots = len(b), max(map(len, limits), default=1)
            scores, own = np.full((n, slots, k), NEVER), np.full((n, slots, k), NO_ID)
            for i, row in enumerate(tops):
                for x in row or []:
                    scores[i, x["slot"], x["rank"] - 1] = x["negative_score"]
                    own[i, x["slot"], x["rank"] - 1] = NO_ID if x["negative_id"] is None else x["negative_id"]
            under, who = merged_upwards(scores, own)
            out = []
            for i, (row, edges) in enumerate(zip(positives, limits, strict=True)):
                for p in row:
                    s = p["positive_score"]
                    j = edges.index(s * HIGHEST // 100)
                    rank = 0
                    for x, y in zip(under[i, j].tolist(), who[i, j].tolist(), strict=True):
                        if x != NEVER and 100 * x >= LOWEST * s:
                            rank += 1
                            out.append((i, p["positive_id"], p["positive_rank"], s, rank, y, x))
            if out:
                i, pid, prank, ps, rank, nid, ns = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(1).take(pa.array(i)), pa.array(pid, pa.int64()), pa.array(prank, pa.int32()), pa.array(rank, pa.int32()),
                        id_array(np.array(nid, np.int64)), pa.array(ps, pa.int64()), pa.array(ns, pa.int64()),
                    ],
                    names=names,
                )

    return run


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(256 x).  An anchor's positives are the first ``positives`` other rows of its label,
    by falling score and rising id; for each, its ``negatives`` first rows of other labels whose score is between 50 and
    95 hundredths of the positive's, both included.  A positive with a score below 0 has no such rows.  Rows with a null
    label or a vector that is null or holds null or non-finite components take no part; shorter vectors count as filled up
    with zeros.  Rows without an id are no anchors and come last among equals; rows with the anchor's id are its own.
    Repeated rows take a place each; repeated anchors (same id, label and vector) are asked once.  Other columns are not
    read, an empty table gives no rows, and scores beyond 64 bits are an error.
    """
    named = rows.where(usable(vector) & F.col(label).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    )
    asked = named.where(F.col("asks") & F.col("id").isNotNull()).select("id", "label", "v").distinct()
    anchors = written(asked.select(F.xxhash64("id", "label", "v").alias("q"), "id", "label", "v"), "anchors")
    others = named.select("id", "label", "v")
    cells = lambda left: [df.groupBy("_x", "_y") for df in dealt(left, others)]

    left, right = cells(anchors)
    same = left.cogroup(right).applyInArrow(_same_label(positives), "q long, anchor_id long, positive_id long, positive_score long")
    first = best(same, positives, ["anchor_id", "q"], "positive_score", "positive_id", "positive_rank").where("positive_score >= 0")
    # Lists of ``positives`` elements at most.  Limits round inwards: both ends of a window are whole numbers.
    limit = F.expr(f"positive_score div 100 * {HIGHEST} + (positive_score % 100) * {HIGHEST} div 100")
    least = F.expr(f"positive_score div 100 * {LOWEST} + ((positive_score % 100) * {LOWEST} + 99) div 100")
    asks = first.groupBy("anchor_id", "q").agg(
        F.sort_array(F.collect_set(limit)).alias("limits"), F.min(least).alias("least"),
        F.sort_array(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("positives"),
    )
    asks = written(anchors.withColumnRenamed("id", "anchor_id").join(asks, ["anchor_id", "q"]).withColumnRenamed("anchor_id", "id"), "windows")

    left, right = cells(asks.select("q", "id", "label", "v", "limits", "least"))
    slots = left.cogroup(right).applyInArrow(_slots(negatives), "q long, anchor_id long, slot int, negative_id long, negative_score long")
    kept = best(slots, negatives, ["anchor_id", "q", "slot"], "negative_score", "negative_id", "rank")
    tops = kept.groupBy("anchor_id", "q").agg(F.collect_list(F.struct("slot", "rank", "negative_id", "negative_score")).alias("tops"))  # positives x negatives at most
    schema = "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long"
    names = [x.split()[0] for x in schema.split(", ")]
    return asks.select("q", F.col("id").alias("anchor_id"), "limits", "positives").join(tops, ["anchor_id", "q"]).select("q", "anchor_id", "limits", "positives", "tops").mapInArrow(_answer(negatives, names), schema)
