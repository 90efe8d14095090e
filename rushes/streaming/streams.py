"""Streaming twins of batch operators, for tables that keep arriving."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rushes.operators.tracking import PLAN, FaceScan, best_of_window
from rushes.session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """A stream over files that appear under a path."""
    reader = spark.readStream.schema(schema).format(fmt)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process everything available now into Parquet under the shared folder and return it as a batch table."""
    return run_and_count(stream, name, mode, path)[0]


def run_and_count(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> tuple[DataFrame, int]:
    """As ``run_to_table``, with the number of rows that came too late for the watermark."""
    spark = stream.sparkSession
    base = path or f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table"), late_rows(query)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators of a query dropped as late, over the progress that it still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def stream_ingest(
    spark: SparkSession, path: str, schema: str, sink: str, errors: str, checkpoint: str
) -> StreamingQuery:
    """Take in new JSON lines; rows that do not parse go to ``errors`` as text.

    Each micro-batch overwrites its own directory, so a repeated batch leaves the same files.
    """
    raw = spark.readStream.schema(f"{schema}, _corrupt string").option(
        "columnNameOfCorruptRecord", "_corrupt"
    ).option("mode", "PERMISSIVE").json(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        good = batch.filter(F.col("_corrupt").isNull()).drop("_corrupt")
        bad = batch.filter(F.col("_corrupt").isNotNull()).select(F.col("_corrupt").alias("value"))
        good.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        bad.write.mode("overwrite").text(f"{errors}/batch={batch_id}")
        batch.unpersist()

    return (
        raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_run_metrics(
    events: DataFrame, watermark: str = "10 minutes", window: str = "1 day", slide: str | None = None,
    keys: Sequence[str] = ("extractor",), at: str = "started_at",
) -> DataFrame:
    """Runs, seconds and mean per window and stage; tumbling, or sliding with ``slide``.

    Rows later than the watermark are dropped and counted in the query's progress.
    """
    frame = F.window(at, window, slide) if slide else F.window(at, window)
    out = events.withWatermark(at, watermark).groupBy(frame.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("seconds").alias("total_seconds"), F.max("seconds").alias("max_seconds")
    )
    return out.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
        "n_runs", "total_seconds", "max_seconds",
    )


def stream_sessions(
    events: DataFrame, gap: str = "5 minutes", watermark: str = "10 minutes", keys: Sequence[str] = ("device",),
    at: str = "started_at",
) -> DataFrame:
    """Activity sessions per device: a pause longer than ``gap`` starts a new one."""
    out = events.withWatermark(at, watermark).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("seconds").alias("total_seconds")
    )
    return out.select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n_runs", "total_seconds"
    )


def stream_first_seen(
    rows: DataFrame, watermark: str, keys: Sequence[str] = ("file_id",), text: str = "text", at: str = "at"
) -> DataFrame:
    """First occurrence of each normalised text per file; a key is remembered for the watermark's length."""
    keyed = rows.withColumn("text_key", F.lower(F.trim(F.col(text))))
    return keyed.withWatermark(at, watermark).dropDuplicatesWithinWatermark([*keys, "text_key"])


class _GreedySampler(StatefulProcessor):
    """Keeps the last kept time of a file; forgotten ``ttl_ms`` after its last change."""

    def __init__(self, t: str, order: list[str], interval: float, ttl_ms: int | None):
        self.t, self.order, self.interval, self.ttl_ms = t, order, interval, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order)
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for t in pdf[self.t]:
            take = last is None or t - last >= self.interval
            keep.append(take)
            if take:
                last = float(t)
        self.last.update((last,))
        yield pdf[keep]

    def close(self) -> None:
        pass


class _OrderedSampler(StatefulProcessor):
    """Greedy sampling by event time: rows wait in typed list state until the watermark has passed them."""

    def __init__(self, columns: list[str], types: T.StructType, t: str, order: list[str], interval: float):
        self.columns, self.types, self.t, self.order, self.interval = columns, types, t, order, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t double")
        self.waiting = handle.getListState("waiting", self.types)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for pdf in rows:  # frame by frame: no batch of a key is held whole
            if not len(pdf):
                continue
            latest = max(latest, int(pdf[_EVENT_US].max()))
            self.waiting.appendList([tuple(_plain(v) for v in row) for row in pdf[self.columns].itertuples(index=False, name=None)])
        if latest:
            self.handle.registerTimer(latest // 1000 + 1)
        yield from ()  # an empty table for each key and batch would cost more than its rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():  # an earlier timer of the key has taken all
            return
        passed, at = timerValues.getCurrentWatermarkInMs() * 1000, self.columns.index(_EVENT_US)
        ready, rest = [], []
        for row in map(tuple, self.waiting.get()):
            (ready if row[at] is not None and row[at] <= passed else rest).append(row)
        if not ready:
            return
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        places = [self.columns.index(c) for c in self.order]
        ready.sort(key=lambda row: [(row[i] is None, 0 if row[i] is None else row[i]) for i in places])
        last, kept, t_at = self.last.get()[0] if self.last.exists() else None, [], self.columns.index(self.t)
        for row in ready:
            t = row[t_at]
            if last is None or t is not None and t - last >= self.interval:
                kept.append(row)
                last = float("nan") if t is None else float(t)  # nothing follows a row without time
        self.last.update((last,))
        if kept:
            yield pd.DataFrame(kept, columns=self.columns)

    def close(self) -> None:
        pass


_EVENT_US = "event_us"


def _plain(v):
    return None if v is None or v is pd.NaT or isinstance(v, float) and v != v else v.item() if hasattr(v, "item") else v


def stream_sample(
    rows: DataFrame, interval: float = 1.0, ttl: float | None = 3600.0, keys: Sequence[str] = ("file_id",),
    order: Sequence[str] = ("t", "idx"), at: str | None = None, watermark: str = "1 minute",
) -> DataFrame:
    """Greedy sampling over arriving rows.

    With ``at``, a timestamp that rises with the order, rows may come in any order within ``watermark``: each waits until
    the watermark has passed it, and later ones are dropped and counted in the query's progress (``late_rows``).  The
    result is that of the batch operator over the rows that weren't late.  The state of a file is its last kept time and
    the rows that wait, as typed columns; ``at`` itself isn't returned.  Without ``at``, rows are taken in time order inside
    a micro-batch only, and ``ttl`` seconds after its last change a file is forgotten; that needs a query that keeps
    running, so pass ``ttl=None`` with ``availableNow``.

    Needs the RocksDB state store (``ROCKSDB``).
    """
    if at is not None:
        timed = rows.withColumn(_EVENT_US, F.unix_micros(at)).withWatermark(at, watermark)
        out = [c for c in rows.columns if c != at]
        columns = [*out, _EVENT_US]
        schema = timed.select(*columns).schema
        sampled = timed.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=_OrderedSampler(columns, schema, order[0], list(order), interval),
            outputStructType=schema, outputMode="Append", timeMode="EventTime",
        )
        return sampled.drop(_EVENT_US)
    ttl_ms = int(ttl * 1000) if ttl else None
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_GreedySampler(order[0], list(order), interval, ttl_ms),
        outputStructType=rows.schema,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


_HEAD = "<ddqqqqq"  # time, confidence, number and box of a detection


def _packed(dtype: str):
    """A detection as bytes, its vector at the end: a processor gets its rows value by value, and vectors would take most of its time."""

    @F.pandas_udf("binary")
    def pack(t: pd.Series, confidence: pd.Series, idx: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, embedding: pd.Series) -> pd.Series:
        rows = zip(t, confidence, idx, x, y, w, h, embedding)
        return pd.Series([struct.pack(_HEAD, *row) + (b"" if v is None else np.asarray(v, dtype).tobytes()) for *row, v in rows], dtype=object)

    return pack


class _FaceScanner(StatefulProcessor):
    """The scan of one file between micro-batches, in typed columns: where it stands, who is known, and what waits.

    Each call to the state store costs more than the rows of a short file.  So files that come whole keep only where the scan
    stands, a file that is new reads nothing more, and one that is over keeps nothing more.
    """

    def __init__(self, make, tol: float, inside: tuple[float, float, float], columns: list[str], whole_files: bool, ttl_ms: int | None, dtype: str):
        self.make, self.tol, self.inside, self.columns, self.whole_files, self.ttl_ms, self.dtype = make, tol, inside, columns, whole_files, ttl_ms, dtype

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scan = handle.getValueState("scan", "duration double, at long, quiet int, probing boolean, number long", self.ttl_ms)
        if not self.whole_files:
            self.known = handle.getListState("known", "v array<double>", self.ttl_ms)
            self.waiting = handle.getListState("waiting", "detection binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stood, waiting = self.scan.get(), []
        scan = self._scan(stood) if stood is not None else None
        for r in rows:
            scan = scan or self.make(r["duration"])
            waiting.append(self._row(r["detection"]))
        if not waiting or stood is not None and scan.over:
            return
        latest = np.inf if self.whole_files else max(r[0] for r in waiting)
        waited, knew = stood is not None and not self.whole_files and self.waiting.exists(), len(scan.known)
        if waited:
            waiting += [self._row(r[0]) for r in self.waiting.get()]
        waiting.sort(key=lambda r: (r[0], r[4]))
        out = []
        while not scan.over and (self.whole_files or scan.end + self.tol < latest):
            low, high, closed = scan.sees(self.tol)
            seen = [r[:4] for r in waiting if low <= r[0] and (r[0] <= high if closed else r[0] < high)]
            out.append((*key, *scan.close(best_of_window(seen, *self.inside))))
            waiting = [r for r in waiting if r[0] >= scan.start - self.tol]
        self.scan.update((scan.duration, scan.at, scan.quiet, scan.probing, scan.number))
        if not self.whole_files:
            self._keep(scan, knew, [] if scan.over else waiting, waited)
        for values in out:
            yield Row(**dict(zip(self.columns, values)))

    def _row(self, packed: bytes) -> tuple:
        t, confidence, idx, *box = struct.unpack_from(_HEAD, packed)
        return t, tuple(box), confidence, np.frombuffer(packed, self.dtype, offset=struct.calcsize(_HEAD)), idx, bytes(packed)

    def _keep(self, scan: FaceScan, knew: int, waiting: list, waited: bool) -> None:
        if scan.over and knew:
            self.known.clear()
        elif not scan.over and len(scan.known) > knew:
            self.known.appendList([(v.tolist(),) for v in scan.known[knew:]])
        if waiting:
            self.waiting.put([(r[5],) for r in waiting])
        elif waited:
            self.waiting.clear()

    def _scan(self, stood: tuple) -> FaceScan:
        duration, at, quiet, probing, number = stood
        scan = self.make(duration)
        scan.at, scan.quiet, scan.probing, scan.number = at, quiet, probing, number
        if not scan.over and not self.whole_files and self.known.exists():
            scan.known = [np.array(v[0]) for v in self.known.get()]
        return scan

    def close(self) -> None:
        pass


def stream_face_scan(
    det: DataFrame, dense: float = 30.0, sparse: float = 10.0, min_duration: float = 60.0, tol: float = 0.35,
    emb: float = 0.5, settle: int = 2, keys: Sequence[str] = ("file_id",), whole_files: bool = False,
    ttl: float | None = 3600.0, gap: float = 5.0, iou: float = 0.2, same: float = 0.5,
) -> DataFrame:
    """Streaming twin of ``plan_face_scan``; detections carry their file's ``duration`` and come in time order.

    A window is reported once a detection shows that it is over, or with the batch when ``whole_files`` says
    that a file's detections all come in one micro-batch.  The state of a file is where its scan stands and, unless it comes whole
    or is over, one vector for each known person and the detections of the windows that are open.
    """
    keys = list(keys)
    inf = F.lit(float("inf"))
    confidence = F.when(F.isnan("confidence"), inf).otherwise(F.coalesce("confidence", -inf))
    box = [F.col(f"bbox.{c}").cast("long") for c in ("x", "y", "width", "height")]
    dtype = "<f4" if det.schema["embedding"].dataType == T.ArrayType(T.FloatType(), det.schema["embedding"].dataType.containsNull) else "<f8"
    packed = _packed(dtype)(F.col("t").cast("double"), confidence, F.col("idx").cast("long"), *box, F.col("embedding"))
    rows = det.filter((F.col("duration") > min_duration) & (F.abs("t") < inf)).select(
        *keys, F.col("duration").cast("double").alias("duration"), packed.alias("detection"))
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*fields, *T.StructType.fromDDL(PLAN).fields])
    ttl_ms = int(ttl * 1000) if ttl else None

    def make(duration: float) -> FaceScan:
        return FaceScan(duration, dense, sparse, emb, settle)

    return rows.groupBy(*keys).transformWithState(
        statefulProcessor=_FaceScanner(make, tol, (gap, iou, same), schema.names, whole_files, ttl_ms, dtype),
        outputStructType=schema,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


def stream_enrich(stream: DataFrame, static: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Left-join a static table; its fields win where they are set."""
    side = static.select(*keys, *[F.col(f).alias(f"_s_{f}") for f in fields])
    joined = stream.join(side, list(keys), "left")
    own = set(stream.columns)
    merged = {f: F.coalesce(F.col(f"_s_{f}"), F.col(f)) if f in own else F.col(f"_s_{f}") for f in fields}
    return joined.withColumns(merged).drop(*[f"_s_{f}" for f in fields])


def _in_buckets(rows: DataFrame, start: str, end: str, bucket: str, watermark: str) -> DataFrame:
    """A copy of each interval for every bucket of time that it touches, with ``_from`` and ``_to``, its part of the bucket."""
    first, step = F.window(F.col(start), bucket)["start"], F.expr(f"INTERVAL {bucket}")
    # An interval that ends on a bucket's edge doesn't touch the next one; an empty one keeps its own.
    last = F.greatest(F.col(start), F.col(end) - F.expr("INTERVAL 1 MICROSECOND"))
    spread = rows.withColumn("_first", first).withColumn("bucket", F.explode(F.sequence(F.col("_first"), last, step))).drop("_first")
    clipped = {"_from": F.greatest(F.col(start), F.col("bucket")), "_to": F.least(F.col(end), F.col("bucket") + step)}
    return spread.withColumns(clipped).withWatermark("bucket", watermark)


def stream_assign(
    segs: DataFrame, turns: DataFrame, bucket: str = "10 minutes", watermark: str = "1 hour",
    keys: Sequence[str] = ("file_id",),
) -> DataFrame:
    """Overlaps of two streams of segments and turns, and segments without any, as they become complete.

    Both have ``idx``, ``start`` and ``end`` timestamps, turns also ``speaker``.  Either may be of any length: they meet in
    every ``bucket`` of time that both touch, so state is dropped by the bucket and a busy file is spread over its buckets.
    Rows: the keys, ``idx``, ``r_idx``, ``speaker``, ``overlap_us`` inside one bucket; a bucket in which a segment
    meets no turn gives a row with nulls once the watermark has passed it.  Rows behind the watermark, which is the lesser of
    both streams' latest bucket less ``watermark``, are dropped and counted in the query's progress (``late_rows``).
    Reduce the rows with ``pick_assignments``.
    """
    a = _in_buckets(segs.select(*keys, "idx", "start", "end"), "start", "end", bucket, watermark)
    b = _in_buckets(turns.select(*keys, "idx", "start", "end", "speaker"), "start", "end", bucket, watermark)
    b = b.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("idx").alias("r_idx"), "speaker", F.col("_from").alias("r_from"),
                 F.col("_to").alias("r_to"), F.col("bucket").alias("r_bucket"))
    on = (F.col("bucket") == F.col("r_bucket")) & (F.col("r_from") < F.col("_to")) & (F.col("r_to") > F.col("_from"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    overlap = F.unix_micros(F.least("_to", "r_to")) - F.unix_micros(F.greatest("_from", "r_from"))
    overlap = F.when(F.col("r_idx").isNotNull(), overlap)
    return a.join(b, on, "leftOuter").select(*keys, "idx", "r_idx", "speaker", overlap.alias("overlap_us"))


def pick_assignments(overlaps: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Per segment the speaker of the longest overlap, the earliest turn on a tie, nulls where no turn overlaps."""
    pairs = overlaps.groupBy(*keys, "idx", "r_idx").agg(F.first("speaker").alias("speaker"), F.sum("overlap_us").alias("overlap_us"))
    rank = F.when(F.col("r_idx").isNotNull(), F.struct("overlap_us", (-F.col("r_idx")).alias("i")))
    return pairs.groupBy(*keys, "idx").agg(F.max_by("speaker", rank).alias("speaker"), F.max("overlap_us").alias("overlap_us"))
