"""Streaming twins over the driver tables: each reads a table as a stream and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushes.plans.bindings import OBS, micros_since, table
from rushes.plans.detect import FACE_SCAN
from rushes.plans.registry import query
from rushes.plans.text import LINES, TALK
from rushes.streaming import streams


def stream_of(spark, sf_dir, name):
    """A driver table as a file stream, whether it is one file or a folder of them."""
    schema = table(spark, sf_dir, name).schema
    return streams.read_files(spark, f"{sf_dir}/{name}.parque[t]", schema)  # a pattern, as a stream's plain path must be a folder


def run_stream(spark, sf_dir):
    return stream_of(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), F.col("user_id").alias("device"), F.col("event_type").alias("extractor"),
        F.col("ts").cast("timestamp").alias("started_at"), F.col("value").alias("seconds"),
    )


def _seconds(col):
    return F.unix_seconds(F.col(col))


CLOSED = """(SELECT epoch_ms(max(ts)) - 600000 AS mark FROM events)"""


@query("stream_run_metrics", f"""
SELECT epoch(date_trunc('day', ts))::BIGINT AS window_start, event_type AS extractor, count(*)::BIGINT AS n_runs,
       round(sum(value), 2) AS total_seconds, max(value) AS max_seconds
FROM events, {CLOSED} WHERE epoch_ms(date_trunc('day', ts) + INTERVAL 1 DAY) <= mark GROUP BY ALL""")
def stream_run_metrics(spark, sf_dir):
    metrics = streams.stream_run_metrics(run_stream(spark, sf_dir))
    out = streams.run_to_table(metrics, "run_metrics")
    return out.select(
        _seconds("window_start").alias("window_start"), "extractor", "n_runs", F.round("total_seconds", 2).alias("total_seconds"), "max_seconds")


@query("stream_run_metrics_sliding", f"""
SELECT w AS window_start, event_type AS extractor, count(*)::BIGINT AS n_runs, round(sum(value), 2) AS total_seconds, max(value) AS max_seconds
FROM (SELECT *, unnest([epoch(ts)::BIGINT // 43200 * 43200, epoch(ts)::BIGINT // 43200 * 43200 - 43200]) AS w
      FROM (SELECT event_type, value, ts - INTERVAL 0 SECOND AS ts FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events))), {CLOSED}
WHERE (w + 86400) * 1000 <= mark GROUP BY ALL""")
def stream_run_metrics_sliding(spark, sf_dir):
    metrics = streams.stream_run_metrics(run_stream(spark, sf_dir), slide="12 hours")
    out = streams.run_to_table(metrics, "run_metrics_sliding")
    return out.select(
        _seconds("window_start").alias("window_start"), "extractor", "n_runs", F.round("total_seconds", 2).alias("total_seconds"), "max_seconds")


@query("stream_sessions", f"""
WITH g AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id AS device, epoch_us(min(ts)) AS session_start, count(*)::BIGINT AS n_runs, round(sum(value), 2) AS total_seconds
FROM s, {CLOSED} GROUP BY user_id, session HAVING epoch_us(max(ts)) + 6 * 3600 * 1000000::BIGINT <= max(mark) * 1000""")
def stream_sessions(spark, sf_dir):
    sessions = streams.stream_sessions(run_stream(spark, sf_dir), gap="6 hours")
    out = streams.run_to_table(sessions, "sessions")
    return out.select("device", F.unix_micros("session_start").alias("session_start"), "n_runs", F.round("total_seconds", 2).alias("total_seconds"))


@query("stream_first_seen", "WITH " + LINES + """
SELECT DISTINCT file_id, md5(lower(trim(text, ' '))) AS key_md5 FROM lines""")
def stream_first_seen(spark, sf_dir):
    docs = stream_of(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    rows = docs.select(F.col("doc_id").alias("file_id"), "text", F.timestamp_seconds(F.col("n").cast("long") + 86400).alias("at"))
    seen = streams.stream_first_seen(rows, "365 days").select("file_id", F.md5("text_key").alias("key_md5"))
    return streams.run_to_table(seen, "first_seen")


SAMPLED = "WITH RECURSIVE " + OBS + """, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY t, idx) AS rn FROM obs
), walk AS (
  SELECT file_id, t, idx, rn, t AS last, true AS keep FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.file_id, o.t, o.idx, o.rn, CASE WHEN o.t - w.last >= 1.0 THEN o.t ELSE w.last END, o.t - w.last >= 1.0
  FROM walk w JOIN ordered o ON o.file_id = w.file_id AND o.rn = w.rn + 1)
SELECT file_id, idx FROM walk WHERE keep"""


@query("stream_sample", SAMPLED)
def stream_sample(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    rows = stream_of(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), (micros_since(F.col("ts"), "2024-01-01").cast("double") / 3.6e10).alias("t"),
        F.col("event_id").alias("idx"))
    return streams.run_to_table(streams.stream_sample(rows, 1.0, ttl=None), "sample").select("file_id", "idx")


@query("stream_sample_ordered", SAMPLED)
def stream_sample_ordered(spark, sf_dir):
    """The same rows in six micro-batches that are dealt without regard to time, so that the timers put them in order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    t = micros_since(F.col("ts"), "2024-01-01").cast("double") / 3.6e10
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), t.alias("t"), F.col("event_id").alias("idx"), F.col("ts").cast("timestamp").alias("at"))
    ahead = spark.range(1).select(
        F.lit(-1).cast("long").alias("file_id"), F.lit(0.0).alias("t"), F.lit(-1).cast("long").alias("idx"), F.timestamp_seconds(F.lit(4102444800)).alias("at"))
    parts = [rows.where(F.col("idx") * 7 % 6 == i) for i in range(6)]
    sampled = streams.stream_sample(arriving([*parts, ahead], "events"), 1.0, at="at", watermark="3650 days")
    return streams.run_to_table(sampled, "sample_ordered").select("file_id", "idx")


@query("stream_face_scan", FACE_SCAN)
def stream_face_scan(spark, sf_dir):
    """Events as faces with an embedding from a table of vectors; a file's duration comes from the batch side."""
    from rushes.functions.media import box
    from rushes.plans.bindings import durations

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    vectors = table(spark, sf_dir, "embeddings")
    n, e = vectors.count(), F.col("event_id")
    det = stream_of(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), (micros_since(F.col("ts"), "2024-01-01").cast("double") / 3.6e10).alias("t"),
        e.alias("idx"), (F.lit(0.4) + (e * 7 % 60) / F.lit(100.0)).alias("confidence"),
        box(e * 37 % 120, e * 53 % 90, e % 120 + 60, e % 90 + 60).alias("bbox"), (e % n).alias("vec_id"))
    det = det.join(durations(spark, sf_dir).select("file_id", "duration"), "file_id")  # many files are shuffled for it: before the vectors
    det = det.join(vectors.select("vec_id", "embedding"), "vec_id")
    plan = streams.stream_face_scan(det.drop("vec_id"), emb=0.8, whole_files=True, ttl=None)
    return streams.run_to_table(plan, "face_scan")


@query("stream_enrich", """
SELECT event_id AS idx, coalesce(c_mktsegment, event_type) AS extractor, c_name AS owner FROM events LEFT JOIN customer ON c_custkey = user_id""")
def stream_enrich(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("device"), F.col("c_mktsegment").alias("extractor"), F.col("c_name").alias("owner"))
    joined = streams.stream_enrich(run_stream(spark, sf_dir), owners, ["device"], ["extractor", "owner"])
    return streams.run_to_table(joined.select("idx", "extractor", "owner"), "enrich")


def arriving(parts, name):
    """A stream over tables that arrive one after the other, each as one file and as a micro-batch of its own."""
    import uuid

    from rushes.session import checkpoint_dir

    spark = parts[0].sparkSession
    base = f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{base}/{i:03d}")
    return streams.read_files(spark, f"{base}/*", parts[0].schema, maxFilesPerTrigger="1")


def _quarters(df):
    """Four tables by rising file, and a last one with a row of file -1 far ahead, which lets the watermark pass all others.

    It must reach the watermark: what filters it out comes after the stream, as Spark moves filters below watermarks.
    """
    top = df.agg(F.max("file_id")).first()[0] or 0
    quarter = (F.col("file_id") * 4 / F.lit(top + 1)).cast("int")
    ahead = {"file_id": F.lit(-1), "start": F.timestamp_seconds(F.lit(4102444800)), "end": F.timestamp_seconds(F.lit(4102444801))}
    empty = [ahead.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return [*(df.where(quarter == i) for i in range(4)), df.sparkSession.range(1).select(*empty)]


SHOWS = """segs AS (
  SELECT conv_id AS file_id, turn AS idx, conv_id * 3600 + turn * 5 AS "start", conv_id * 3600 + turn * 5 + 5 AS "end" FROM conversations
), turns AS (
  SELECT conv_id AS file_id, turn AS idx, conv_id * 3600 + turn * 5 - length(text) % 7 AS "start",
         conv_id * 3600 + turn * 5 + 1 + length(text) % 11 + CASE WHEN conv_id % 4 = 1 AND turn = 0 THEN 7200 ELSE 0 END AS "end", role AS speaker
  FROM conversations WHERE conv_id % 5 <> 2 AND (conv_id + turn) % 3 <> 0)"""


@query("stream_assign", "WITH " + SHOWS + """, ranked AS (
  SELECT s.file_id, s.idx, t.speaker, least(s."end", t."end") - greatest(s."start", t."start") AS overlap, row_number() OVER (
    PARTITION BY s.file_id, s.idx ORDER BY least(s."end", t."end") - greatest(s."start", t."start") DESC, t.idx) AS r
  FROM segs s JOIN turns t ON s.file_id = t.file_id AND t."start" < s."end" AND t."end" > s."start")
SELECT s.file_id, s.idx, r.speaker, (r.overlap * 1000000)::BIGINT AS overlap_us
FROM segs s LEFT JOIN ranked r ON r.file_id = s.file_id AND r.idx = s.idx AND r.r = 1""")
def stream_assign(spark, sf_dir):
    """Five micro-batches; some turns last over two hours, and some segments have no turn."""
    conv = table(spark, sf_dir, "conversations")
    base, n = F.col("conv_id") * 3600 + F.col("turn") * 5, F.length("text")

    def at(seconds):
        return F.timestamp_seconds(seconds + 86400)

    long = F.when((F.col("conv_id") % 4 == 1) & (F.col("turn") == 0), 7200).otherwise(0)
    segs = conv.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"), at(base).alias("start"), at(base + 5).alias("end"))
    turns = conv.where("conv_id % 5 <> 2 and (conv_id + turn) % 3 <> 0").select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"), at(base - n % 7).alias("start"),
        at(base + 1 + n % 11 + long).alias("end"), F.col("role").alias("speaker"))
    found = streams.stream_assign(arriving(_quarters(segs), "segs"), arriving(_quarters(turns), "turns"), watermark="4 hours")
    return streams.pick_assignments(streams.run_to_table(found, "assign").where("file_id >= 0"))


@query("stream_ingest", """
SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations""")
def stream_ingest(spark, sf_dir):
    """Rows of a table as JSON lines taken in by the ingest stream."""
    import uuid

    from rushes.session import checkpoint_dir

    base = f"{checkpoint_dir(spark)}/streams/ingest-{uuid.uuid4().hex}"
    table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n")).write.json(f"{base}/in")
    done = streams.stream_ingest(
        spark, f"{base}/in", "conv_id long, turn long, n long", f"{base}/rows", f"{base}/errors", f"{base}/checkpoint")
    done.awaitTermination()
    return spark.read.parquet(f"{base}/rows").select("conv_id", "turn", "n")
