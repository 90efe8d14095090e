"""Tracking, where each decision depends on the ones before it.

Rows are hashed by series, sorted inside the partition, and streamed in Arrow batches through a small state
machine.  Only the live state (recent boxes, known people) is in memory, never the series itself.  Object tracks
cannot outlive a pause longer than the gap, so a long series is first cut at such pauses and its pieces
run in parallel.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rushes.operators.ordered import ROWS_PER_SLICE, SLICE, drop_slice, ordered_scan, slice_series
from rushes.session import checkpoint_dir

Box = tuple[int, int, int, int]


def _iou(a: Box, b: Box) -> float:
    across = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    down = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if across <= 0 or down <= 0:
        return 0.0
    shared = across * down
    return shared / (a[2] * a[3] + b[2] * b[3] - shared)


def apply_state(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    make_state: Callable[[], Callable[..., object]],
    inputs: Sequence[str],
    name: str,
    data_type: T.DataType,
) -> DataFrame:
    """Run a keyed state machine over ordered rows and add what it returns for each row as ``name``.

    ``make_state()`` is called at the start of each series and returns a function of the ``inputs`` of a row.
    """
    keys, inputs = list(keys), list(inputs)
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*placed.schema.fields, T.StructField(name, data_type)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for pdf in frames:
            ids = list(zip(*[pdf[k] for k in keys]))
            out = []
            for key, row in zip(ids, zip(*[pdf[c] for c in inputs])):
                if step is None or key != current:
                    current, step = key, make_state()
                out.append(step(*row))
            yield pdf.assign(**{name: pd.Series(out, index=pdf.index)})

    return placed.mapInPandas(run, schema)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_{c[0]}": F.col(f"bbox.{c}") for c in ("x", "y", "width", "height")})


def _object_state(gap: float, iou: float):
    def make():
        live: list[list] = []  # [track number, last time, last box], in order of creation
        count = 0

        def step(t, x, y, w, h):
            nonlocal live, count
            live = [track for track in live if t - track[1] <= gap]
            here = (x, y, w, h)
            for track in live:
                if _iou(here, track[2]) >= iou:
                    track[1], track[2] = t, here
                    return track[0]
            live.append([count, t, here])
            count += 1
            return count - 1

        return step

    return make


def track_objects(
    df: DataFrame,
    gap: float = 5.0,
    iou: float = 0.3,
    keys: Sequence[str] = ("file_id", "label"),
    order: Sequence[str] = ("t", "idx"),
    **slicing,
) -> DataFrame:
    """Add ``track`` (numbered from 0 per series): the first track whose last box is recent and overlaps, else a new one."""
    t = order[0]
    cols = df.columns
    df = slice_series(_flat(df), keys, t, **slicing)
    inputs = [t, "_x", "_y", "_w", "_h"]
    if SLICE not in df.columns:
        tracked = apply_state(df, keys, order, _object_state(gap, iou), inputs, "track", T.LongType())
        return tracked.select(*cols, "track")

    stepped = ordered_scan(df, keys, order, prev={"_prev_t": t})
    pause = F.coalesce(F.col(t) - F.col("_prev_t") > gap, F.lit(False))
    pieces = drop_slice(ordered_scan(stepped, keys, order, cum={"_piece": pause.cast("long")}))
    tracked = apply_state(pieces, [*keys, "_piece"], order, _object_state(gap, iou), inputs, "_track", T.LongType())
    # Pieces number their tracks from 0; the tracks of earlier pieces come first.
    sizes = tracked.groupBy(*keys, "_piece").agg((F.max("_track") + 1).alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_count").over(before), F.lit(0))).drop("_count")
    joined = tracked.join(sizes, [*keys, "_piece"])
    return joined.select(*cols, (F.col("_track") + F.col("_offset")).alias("track"))


class _People:
    """Known people of one file: recent boxes per person, and all their embeddings in one growing matrix."""

    def __init__(self, gap: float, iou: float, emb: float):
        self.gap, self.iou, self.emb = gap, iou, emb
        self.recent: list[list[tuple[float, Box]]] = []
        self.matrix: np.ndarray | None = None
        self.owner = np.zeros(0, dtype="int64")
        self.used = 0

    def _remember(self, vector: np.ndarray, person: int) -> None:
        if self.matrix is None:
            self.matrix = np.empty((16, len(vector)))
            self.owner = np.empty(16, dtype="int64")
        if self.used == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
            self.owner = np.concatenate([self.owner, np.empty_like(self.owner)])
        self.matrix[self.used] = vector
        self.owner[self.used] = person
        self.used += 1

    def _by_position(self, t: float, here: Box) -> int | None:
        for person, boxes in enumerate(self.recent):
            if boxes and t - boxes[0][0] > self.gap:
                boxes[:] = [b for b in boxes if t - b[0] <= self.gap]
            if any(_iou(here, b) >= self.iou for _, b in boxes):
                return person
        return None

    def _by_embedding(self, vector: np.ndarray | None) -> int | None:
        if vector is None or not self.used:
            return None
        distance = 1.0 - self.matrix[: self.used] @ vector
        nearest = distance.min()
        if not nearest < self.emb:
            return None
        return int(self.owner[: self.used][distance == nearest].min())

    def place(self, t: float, here: Box, embedding) -> int:
        vector = None
        if embedding is not None and len(embedding):
            raw = np.asarray(embedding, dtype="float64")
            length = np.linalg.norm(raw)
            vector = raw / length if length > 0 else None
        person = self._by_position(t, here)
        if person is None:
            person = self._by_embedding(vector)
        if person is None:
            person = len(self.recent)
            self.recent.append([])
        self.recent[person].append((t, here))
        if vector is not None:
            self._remember(vector, person)
        return person


def track_persons(
    df: DataFrame,
    gap: float = 5.0,
    iou: float = 0.2,
    emb: float = 0.5,
    keys: Sequence[str] = ("file_id",),
    order: Sequence[str] = ("t", "idx"),
    rows_per_slice: int | None = ROWS_PER_SLICE,
    seconds: float = 600.0,
) -> DataFrame:
    """Add ``person``: a recent overlapping box decides, else the nearest embedding below ``emb``, else a new person.

    ``order`` names the detections of a file.  Where some file has more than ``rows_per_slice`` of them, files are cut into
    slices of ``seconds`` that are worked on side by side, see ``_sliced_persons``; the rows are the same.
    """
    cols = df.columns
    keys, order = list(keys), list(order)
    if rows_per_slice is not None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_slice)
        if not sizes.isEmpty():
            return _sliced_persons(df, gap, iou, emb, keys, order, max(seconds, gap)).select(*cols, "person")

    def make():
        people = _People(gap, iou, emb)
        return lambda t, x, y, w, h, e: people.place(t, (x, y, w, h), e)

    inputs = [order[0], "_x", "_y", "_w", "_h", "embedding"]
    tracked = apply_state(_flat(df), keys, order, make, inputs, "person", T.LongType())
    return tracked.select(*cols, "person")


class _LiveBoxes:
    """Recent boxes in a grid, each with the node that it belongs to."""

    CELL = 64

    def __init__(self, gap: float, iou: float):
        self.gap, self.iou = gap, iou
        self.live: deque = deque()
        self.grid: dict[tuple[int, int], dict[int, tuple]] = {}
        self.number = 0

    def _cells(self, box: Box):
        c = self.CELL
        return [(i, j) for i in range(box[0] // c, (box[0] + box[2]) // c + 1) for j in range(box[1] // c, (box[1] + box[3]) // c + 1)]

    def nodes(self, t: float, box: Box) -> list:
        """The nodes of the recent boxes that overlap, each once."""
        while self.live and t - self.live[0][0] > self.gap:
            _, number, cells = self.live.popleft()
            for cell in cells:
                del self.grid[cell][number]
                if not self.grid[cell]:
                    del self.grid[cell]
        met = {}
        for cell in self._cells(box):
            met.update(self.grid.get(cell, ()))
        return list(dict.fromkeys(node for other, node in met.values() if _iou(box, other) >= self.iou))

    def add(self, t: float, box: Box, node) -> None:
        cells = self._cells(box)
        for cell in cells:
            self.grid.setdefault(cell, {})[self.number] = (box, node)
        self.live.append((t, self.number, cells))
        self.number += 1


_NODE = "struct<t:double,idx:long>"


def _sliced_persons(df: DataFrame, gap: float, iou: float, emb: float, keys: list[str], order: list[str], seconds: float) -> DataFrame:
    """Person tracking with the work of a file spread over slices of time.

    Which person a detection is depends on all before it, but most of that doesn't depend on who they are.  Each slice,
    which also sees the last ``gap`` seconds before it, groups its detections into nodes: one that overlaps boxes of a
    single node belongs to it; one that overlaps none is the root of a node, and one that overlaps several a junction that
    remembers them.  Boxes from before the slice stand for themselves.  For the roots, the nearest of all earlier embeddings
    is searched in blocks of two slices' vectors.  What is left to do in order is one short row for each root, junction and
    detection at the end of a slice: a root is the least person of its nearest embeddings or a new one, a junction the
    least person of its nodes.
    """
    t, idx = order[0], order[1]
    checkpoint_dir(df.sparkSession)
    own = F.floor(F.col(t) / seconds).cast("long")
    into_next = F.when((own + 1) * seconds - F.col(t) <= gap, F.array(own, own + 1)).otherwise(F.array(own))
    spread = _flat(df).withColumns({"_own": own, "_slice": F.explode(into_next)})
    placed = spread.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", *order)
    schema = T.StructType([*placed.schema.fields, *T.StructType.fromDDL(f"_node {_NODE}, _kind string, _nodes array<{_NODE}>").fields])

    def group(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, boxes = None, None
        for pdf in frames:
            found, keep = [], []
            columns = [*keys, "_slice", "_own", t, idx, "_x", "_y", "_w", "_h"]
            for row in zip(*[pdf[c] for c in columns]):
                key, (own_slice, at, number, *box) = row[: len(keys) + 1], row[len(keys) + 1 :]
                if key != current:
                    current, boxes = key, _LiveBoxes(gap, iou)
                name, box = (float(at), int(number)), tuple(int(v) for v in box)
                before = own_slice != key[-1]
                nodes = [] if before else boxes.nodes(at, box)
                node = nodes[0] if len(nodes) == 1 else name
                boxes.add(at, box, node)
                keep.append(not before)
                if not before:
                    found.append((node, "member" if len(nodes) == 1 else "junction" if nodes else "root", nodes if len(nodes) > 1 else None))
            out = pdf[keep]
            node, kind, nodes = zip(*found) if found else ((), (), ())
            named = lambda x: {"t": x[0], "idx": x[1]}
            yield out.assign(
                _node=pd.Series([named(x) for x in node], index=out.index, dtype=object), _kind=pd.Series(kind, index=out.index, dtype=object),
                _nodes=pd.Series([x and [named(y) for y in x] for x in nodes], index=out.index, dtype=object),
            )

    grouped = placed.mapInPandas(group, schema).checkpoint()
    name = F.struct(F.col(t).cast("double").alias("t"), F.col(idx).cast("long").alias("idx"))
    nearest = _nearest_earlier(grouped.withColumn("_name", name), emb, keys)
    # Members that the next slice may name as boxes before it, and all that starts a node.
    tail = (F.col("_own") + 1) * seconds - F.col(t) <= gap
    nodes = grouped.where((F.col("_kind") != "member") | tail).select(*keys, name.alias("_name"), "_node", "_kind", "_nodes")
    nodes = nodes.join(nearest, [*keys, "_name"], "left").select(*keys, "_name", "_node", "_kind", "_nodes", "_nearest")
    walked = nodes.repartition(*keys).sortWithinPartitions(*keys, "_name")
    out_schema = T.StructType([*walked.select(*keys, "_name").schema.fields, T.StructField("person", T.LongType())])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, person_of, count = None, {}, 0
        for pdf in frames:
            out = []
            for key, (name, node, kind, nodes, near) in zip(zip(*[pdf[k] for k in keys]), zip(*[pdf[c] for c in ("_name", "_node", "_kind", "_nodes", "_nearest")])):
                if key != current:
                    current, person_of, count = key, {}, 0
                here = (name["t"], name["idx"])
                if kind == "member":
                    person = person_of[node["t"], node["idx"]]
                elif kind == "junction":
                    person = min(person_of[x["t"], x["idx"]] for x in nodes)
                elif near is not None and len(near):
                    least = min(x["d"] for x in near)
                    person = min(person_of[y["t"], y["idx"]] for x in near if x["d"] == least for y in x["nodes"])
                else:
                    person, count = count, count + 1
                person_of[here] = person
                out.append((*key, name, person))
            yield pd.DataFrame(out, columns=[*keys, "_name", "person"])

    persons = walked.mapInPandas(walk, out_schema).withColumnRenamed("_name", "_node")
    return grouped.join(persons, [*keys, "_node"])


def _nearest_earlier(grouped: DataFrame, emb: float, keys: list[str], together: int = 8) -> DataFrame:
    """For every root: ``_nearest``, an entry for each slice with the least distance below ``emb`` to an earlier embedding and its nodes."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    vectors = grouped.where(usable).select(*keys, "_own", "_name", "_node", "_kind", F.col("embedding").cast("array<double>").alias("v"))
    last = vectors.where("_kind = 'root'").groupBy(*keys).agg(F.floor(F.max("_own") / together).alias("_last"))
    # Roots of ``together`` slices meet one slice of earlier vectors at a time.
    block = F.floor(F.col("_own") / together)
    first = vectors.groupBy(*keys).agg(F.min("_own").alias("_first"))
    roots = vectors.where("_kind = 'root'").join(first, keys).select(
        *keys, "_name", "v", block.alias("_block"), F.explode(F.sequence("_first", "_own")).alias("_slice"))
    there = vectors.join(last, keys).where(block <= F.col("_last")).select(
        *keys, "_name", "_node", "v", F.col("_own").alias("_slice"), F.explode(F.sequence(block, F.col("_last"))).alias("_block"))
    schema = T.StructType([*vectors.select(*keys, "_name").schema.fields, *T.StructType.fromDDL(f"d double, nodes array<{_NODE}>").fields])
    cell = [*keys, "_slice", "_block"]

    def unit(column) -> np.ndarray:
        m = np.stack([np.asarray(v, dtype="float64") for v in column])
        with np.errstate(divide="ignore", invalid="ignore"):
            return m / np.linalg.norm(m, axis=1, keepdims=True)

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.assign(_k=[(x["t"], x["idx"]) for x in right["_of_name"]]).sort_values("_k")
            m, order_of = unit(right["_ofv"]), right["_k"].tolist()
            for name, q in zip(left["_name"], unit(left["v"])):
                n = bisect_left(order_of, (name["t"], name["idx"]))
                rough = 1.0 - m[:n] @ q
                if not n or np.isnan(q).any() or not (least := np.nanmin(rough, initial=np.inf)) < emb + 1e-9:
                    continue
                # Equal vectors get equal distances whatever their place in the block.
                at = np.flatnonzero(rough <= least + 1e-9)
                exact = 1.0 - (m[at] * q).sum(axis=1)
                least = exact.min()
                if least < emb:
                    nodes = {(x["t"], x["idx"]) for x in right["_of_node"].iloc[at[exact == least]]}
                    out.append((*key[: len(keys)], name, least, [{"t": a, "idx": b} for a, b in nodes]))
        return pd.DataFrame(out, columns=schema.names)

    # Under other names, as both sides come from one table.
    there = there.select(*[F.col(c).alias(f"_of{c}") for c in there.columns])
    found = roots.groupBy(*cell).cogroup(there.groupBy(*[f"_of{c}" for c in cell])).applyInPandas(search, schema)
    return found.groupBy(*keys, "_name").agg(F.collect_list(F.struct("d", "nodes")).alias("_nearest"))  # one entry for each slice


PLAN = "window long, start double, end double, mode string, n_faces long, n_new long, all_known boolean"


def _steps(dense: float, sparse: float) -> tuple[float, int, int]:
    """The largest step of which both kinds of window are whole multiples, and how many steps each takes."""
    a, b = Fraction(str(dense)), Fraction(str(sparse))
    unit = Fraction(gcd(a.numerator * b.denominator, b.numerator * a.denominator), a.denominator * b.denominator)
    return float(unit), int(a / unit), int(b / unit)


class FaceScan:
    """The state of one file's scan: where the next window starts, in steps, and who is known."""

    def __init__(self, duration: float, dense: float, sparse: float, emb: float, settle: int):
        self.duration, self.sparse, self.emb, self.settle = duration, sparse, emb, settle
        self.unit, self.dense_steps, self.sparse_steps = _steps(dense, sparse)
        self.at, self.quiet, self.probing, self.number = 0, 0, False, 0
        self.known: list[np.ndarray] = []

    @property
    def start(self) -> float:
        return self.at * self.unit

    @property
    def end(self) -> float:
        return min((self.at + (self.sparse_steps if self.probing else self.dense_steps)) * self.unit, self.duration)

    @property
    def over(self) -> bool:
        return self.start >= self.duration

    def sees(self, tol: float) -> tuple[float, float, bool]:
        """The times that the next window looks at, and whether the last one counts."""
        if not self.probing:
            return self.start, self.end, False
        middle = self.start + self.sparse / 2
        return middle - tol, middle + tol, True

    def close(self, faces: list) -> tuple:
        """Take the window with the embeddings of its ``faces``, one for each person; go on to the next one."""
        fresh = []
        for e in faces:
            if e is None or not len(e):
                continue
            v = np.asarray(e, dtype="float64")
            v = v / np.linalg.norm(v)
            if not self.known or not (1.0 - np.stack(self.known) @ v < self.emb).any():
                fresh.append(v)
        row = (self.number, self.start, self.end, "sparse" if self.probing else "dense", len(faces), len(fresh), not fresh)
        self.at, self.number = self.at + (self.sparse_steps if self.probing else self.dense_steps), self.number + 1
        if fresh:
            self.known += fresh
            self.quiet, self.probing = 0, False
        elif bool(faces) == bool(self.known):
            self.quiet += 1
            self.probing = self.probing or self.quiet >= self.settle
        return row


def best_of_window(rows, gap: float, iou: float, same: float) -> list:
    """The embedding of the best face of each person among ``rows`` (t, box, confidence, embedding), in order."""
    people = _People(gap, iou, same)
    best: dict[int, tuple] = {}
    for t, here, confidence, embedding in rows:
        person = people.place(t, here, embedding)
        if person not in best or confidence > best[person][0]:
            best[person] = (confidence, embedding)
    return [e for _, e in best.values()]


def close_windows(scan: FaceScan, rows: list, upto: float, tol: float, inside: tuple[float, float, float]) -> tuple[list[tuple], list]:
    """Close the windows of a scan that are over once a detection at ``upto`` comes; what they found, and the rows still needed.

    ``rows`` are (t, box, confidence, embedding) in order.
    """
    out = []
    while not scan.over:
        low, high, closed = scan.sees(tol)
        if not (high < upto if closed else high <= upto):
            break
        out.append(scan.close(best_of_window([r for r in rows if low <= r[0] and (r[0] <= high if closed else r[0] < high)], *inside)))
        rows = [r for r in rows if r[0] >= scan.start - tol]
    return out, rows


class _Block:
    """All windows that a scan may come to and that start in one block of a long file's steps, as detections pass them."""

    def __init__(self, duration: float, first: int, steps: int, dense: float, sparse: float, tol: float, inside: tuple[float, float, float]):
        self.duration, self.sparse, self.tol, self.inside = duration, sparse, tol, inside
        self.unit, self.dense_steps, _ = _steps(dense, sparse)
        self.step, self.end, self.rows = first, first + steps, []

    @property
    def over(self) -> bool:
        return self.step >= self.end or self.step * self.unit >= self.duration

    def close(self, upto: float) -> list[tuple]:
        out = []
        while not self.over:
            start = self.step * self.unit
            middle, end = start + self.sparse / 2, min((self.step + self.dense_steps) * self.unit, self.duration)
            if max(middle + self.tol, end) >= upto:
                break
            for mode, seen in (("dense", [r for r in self.rows if start <= r[0] < end]),
                               ("sparse", [r for r in self.rows if middle - self.tol <= r[0] <= middle + self.tol])):
                if seen:
                    out.append((self.step, mode, best_of_window(seen, *self.inside)))
            self.step += 1
            self.rows = [r for r in self.rows if r[0] >= self.step * self.unit - self.tol]
        return out


def plan_face_scan(
    files: DataFrame,
    det: DataFrame,
    dense: float = 30.0,
    sparse: float = 10.0,
    min_duration: float = 60.0,
    tol: float = 0.35,
    emb: float = 0.5,
    settle: int = 2,
    keys: Sequence[str] = ("file_id",),
    gap: float = 5.0,
    iou: float = 0.2,
    same: float = 0.5,
    seconds: float = 600.0,
) -> DataFrame:
    """Scan plan of files longer than ``min_duration``: one row per window with its mode and what it found.

    A dense window sees the detections in ``[start, end)``; a sparse one those within ``tol`` of its single
    probe at ``start + sparse / 2``.  After ``settle`` windows without a new face the scan turns sparse; a new
    face turns it dense.  Windows without any face count only while nobody is known.  ``emb`` says who is known from
    earlier windows; ``gap``, ``iou`` and ``same`` say who is one person inside a window.

    Detections and files are shuffled together, once, and walked through in time order; a walk holds the detections of the
    windows that are open.  A file of up to ``seconds`` is walked through as a whole.  A longer one is cut into blocks of that
    length: a window's start is a whole number of steps, whatever came before it, so the blocks work out side by side what
    each window that the scan may come to would see, and what then walks through the file in order is one small row per window
    that has faces.
    """
    keys, inside = list(keys), (gap, iou, same)
    unit, dense_steps, sparse_steps = _steps(dense, sparse)
    steps = max(int(seconds / unit), dense_steps, sparse_steps)
    span, t = steps * unit, F.col("t")
    last = F.greatest(F.ceil(F.col("duration") / span).cast("long") - 1, F.lit(0).cast("long"))
    blocks = files.filter(F.col("duration") > min_duration).select(
        *keys, F.col("duration").cast("double").alias("duration"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_block"))
    # The windows that may see a detection start so long before it or after it; a second more, against rounding.
    low = F.floor((t - max(dense, sparse / 2 + tol) - 1) / span)
    high = F.floor((t + max(tol - sparse / 2, 0.0) + 1) / span)
    zero, inf = F.lit(0).cast("long"), F.lit(float("inf"))
    timed = det.where(F.abs(t) < inf).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    rows = _flat(timed).select(
        *keys, t.cast("double").alias("t"), "idx", F.when(F.isnan("confidence"), inf).otherwise(F.coalesce("confidence", -inf)).alias("confidence"),
        "_x", "_y", "_w", "_h", "embedding", F.explode(F.sequence(F.greatest(low, zero), F.greatest(high, zero))).alias("_block"))
    both = rows.unionByName(blocks, allowMissingColumns=True)
    placed = both.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", F.col("duration").isNull(), "t", "idx")
    fields = [f for f in placed.schema.fields if f.name in keys]
    plan = T.StructType.fromDDL(PLAN).fields
    names = [f.name for f in plan]
    vector = next(f.dataType for f in placed.schema.fields if f.name == "embedding")
    mixed = [*fields, *T.StructType.fromDDL("duration double, _step long, _mode string").fields, T.StructField("_faces", T.ArrayType(vector)), *plan]
    width, schema = len(plan), T.StructType([*fields, *plan])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, held = None, None, []

        def close(upto: float) -> list[tuple]:
            nonlocal held
            key = current[: len(keys)]
            if isinstance(state, FaceScan):
                done, held = close_windows(state, held, upto, tol, inside)
                return [(*key, None, None, None, None, *r) for r in done]
            return [(*key, state.duration, *r, *[None] * width) for r in state.close(upto)]

        for pdf in frames:
            out = []
            for *key, duration, at, x, y, w, h, confidence, embedding in zip(*[pdf[c] for c in (*keys, "_block", "duration", "t", "_x", "_y", "_w", "_h", "confidence", "embedding")]):
                key = tuple(key)
                if key != current:
                    out += close(np.inf) if state is not None else []
                    current, state, held = key, None, []
                    if duration == duration and duration is not None:  # else no file, or one that is too short
                        if duration <= span:
                            state = FaceScan(duration, dense, sparse, emb, settle)
                        else:
                            state = _Block(duration, key[-1] * steps, steps, dense, sparse, tol, inside)
                            if key[-1] == 0:  # for files without any face
                                out.append((*key[: len(keys)], duration, None, None, None, *[None] * width))
                if state is None or at != at or at is None:
                    continue
                out += close(at)
                if not state.over:
                    (held if isinstance(state, FaceScan) else state.rows).append((at, (x, y, w, h), confidence, embedding))
            yield _typed(out, [*keys, "duration", "_step", "_mode", "_faces", *names])
        if state is not None:
            yield _typed(close(np.inf), [*keys, "duration", "_step", "_mode", "_faces", *names])

    walked = placed.mapInPandas(walk, T.StructType(mixed)).repartition(*keys).sortWithinPartitions(*keys, "_step", "window")

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pass on what is done and walk through the windows of long files."""
        current, scan, ahead = None, None, {}

        def go(upto: float) -> list[tuple]:
            """Close all windows that start before step ``upto``."""
            out = []
            while not scan.over and scan.at < upto:
                out.append((*current, *scan.close(ahead.get((scan.at, "sparse" if scan.probing else "dense"), []))))
            for key in [k for k in ahead if k[0] < scan.at]:
                del ahead[key]
            return out

        for pdf in frames:
            done = pdf["window"].notna()
            if done.any():
                yield pdf.loc[done, [*keys, *names]].astype({"window": "int64", "n_faces": "int64", "n_new": "int64", "all_known": "bool"})
            out, open_ = [], pdf[~done]
            for *key, duration, step, mode, faces in zip(*[open_[c] for c in (*keys, "duration", "_step", "_mode", "_faces")]):
                if tuple(key) != current:
                    out += go(np.inf) if scan is not None else []
                    current, scan, ahead = tuple(key), FaceScan(duration, dense, sparse, emb, settle), {}
                if mode is not None:
                    out += go(step)
                    ahead[int(step), mode] = list(faces)
            yield pd.DataFrame(out, columns=[*keys, *names])
        if scan is not None:
            yield pd.DataFrame(go(np.inf), columns=[*keys, *names])

    return walked.mapInPandas(join, schema)


def _typed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows with whole numbers that may be missing."""
    return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("_step", "window", "n_faces", "n_new")})
