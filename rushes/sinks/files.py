"""Writing results: nested documents, status views, GPX tracks and rate history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rushes.operators.aggregates import last_rates
from rushes.operators.ordered import ordered_scan, slice_series
from rushes.session import checkpoint_dir


def nest(
    rows: DataFrame, name: str, order: Sequence[str], keys: Sequence[str] = ("file_id",), part_rows: int = 100_000,
    **slicing,
) -> DataFrame:
    """One array of structs per key and part, in order; a part holds at most ``part_rows`` elements.

    Ordinary files have one part (0).  A file with more rows continues in parts 1, 2, ..., so no single
    value grows without bound and nothing is left out.
    """
    fields = [c for c in rows.columns if c not in keys]
    df = slice_series(rows, keys, order, **slicing)
    numbered = ordered_scan(df, keys, order, position="_pos")
    part = F.floor(F.col("_pos") / part_rows).alias("part")
    grouped = numbered.groupBy(*keys, part).agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.struct(*fields).alias("_v")))).alias("_rows")
    )
    return grouped.select(*keys, "part", F.transform("_rows", lambda r: r["_v"]).alias(name))


def assemble_documents(
    files: DataFrame, single: dict[str, DataFrame] | None = None, nested: dict[str, DataFrame] | None = None,
    keys: Sequence[str] = ("file_id",),
) -> DataFrame:
    """One document per file and part with everything under ``results``.

    ``single`` tables have one row per file (a struct in the document); ``nested`` tables come from ``nest``.
    All sides are keyed by file, so the joins share one partitioning.
    """
    keys = list(keys)
    out = files
    names = []
    for name, df in (single or {}).items():
        body = [c for c in df.columns if c not in keys]
        out = out.join(df.select(*keys, F.struct(*body).alias(name)), keys, "left")
        names.append(name)
    parts = None
    for name, df in (nested or {}).items():
        parts = df if parts is None else parts.join(df, [*keys, "part"], "full")
        names.append(name)
    if parts is not None:
        out = out.join(parts, keys, "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    else:
        out = out.withColumn("part", F.lit(0).cast("long"))
    return out.select(*files.columns, "part", F.struct(*names).alias("results"))


def write_documents(docs: DataFrame, path: str, fmt: str = "parquet") -> None:
    docs.write.mode("overwrite").format(fmt).save(path)


def status_view(docs: DataFrame) -> DataFrame:
    """The documents without their results; on Parquet the results column is not read."""
    return docs.drop("results")


GPX_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="rushes">\n  <trk>\n    <name>Flight Path</name>\n    <trkseg>'
GPX_TAIL = "    </trkseg>\n  </trk>\n</gpx>"


def gpx_lines(points: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Lines of one GPX document per file: ``section`` (0 head, 1 points, 2 tail), ``t``, ``line``.

    Points need ``t, latitude, longitude, altitude, recorded_at``; an altitude of 0 is left out.
    """
    height = F.when(
        F.col("altitude") != 0, F.concat(F.lit("<ele>"), F.col("altitude").cast("string"), F.lit("</ele>"))
    )
    stamp = F.date_format(F.col("recorded_at").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    time = F.when(stamp.isNotNull(), F.concat(F.lit("<time>"), stamp, F.lit("Z</time>")))
    line = F.concat(
        F.lit('      <trkpt lat="'), F.col("latitude").cast("string"), F.lit('" lon="'),
        F.col("longitude").cast("string"), F.lit('">'), F.coalesce(height, F.lit("")), F.coalesce(time, F.lit("")),
        F.lit("</trkpt>"),
    )
    body = points.select(*keys, F.lit(1).alias("section"), F.col("t").cast("double").alias("t"), line.alias("line"))
    names = points.select(*keys).distinct()
    frame = names.select(
        *keys,
        F.explode(F.array(
            F.struct(F.lit(0).alias("section"), F.lit(None).cast("double").alias("t"), F.lit(GPX_HEAD).alias("line")),
            F.struct(F.lit(2).alias("section"), F.lit(None).cast("double").alias("t"), F.lit(GPX_TAIL).alias("line")),
        )).alias("_l"),
    ).select(*keys, "_l.*")
    return body.unionByName(frame)


def write_gpx(points: DataFrame, path: str, partitions: int | None = None) -> None:
    """One directory per file with its GPX document: points in order of time, of equal times by their text.

    Without ``partitions`` each directory holds one text file, a whole document: the lines of a file go to one task, which
    sorts them on disk and writes them as they come.  With ``partitions``, lines are ranged over so many tasks by file and
    time, so that a file of any length is written in parallel; its part files in name order are the document.
    """
    lines = gpx_lines(points)
    order = ["file_id", "section", "t", "line"]
    placed = lines.repartitionByRange(partitions, *order) if partitions else lines.repartition("file_id")
    placed.sortWithinPartitions(*order).select("file_id", "line").write.mode("overwrite").partitionBy("file_id").text(path)


def write_gpx_packs(points: DataFrame, path: str) -> None:
    """GPX documents of very many files in few: Parquet tables of their lines, each document whole and in order in one of them.

    A folder for each file, as ``write_gpx`` makes it, costs the driver time for each one; this costs it time for each task.
    """
    order = ["file_id", "section", "t", "line"]
    gpx_lines(points).repartition("file_id").sortWithinPartitions(*order).select(*order).write.mode("overwrite").parquet(path)


def read_gpx_packs(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, n_files, text`` of packed documents; ``n_files`` is how many of the tables hold lines of it."""
    lines = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    found = lines.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("section", "t", "line"))).alias("_l"), F.size(F.collect_set("_file")).cast("long").alias("n_files"))
    text = F.concat(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n"))
    return found.select("file_id", "n_files", text.alias("text"))


def save_rates(rates: DataFrame, path: str, n: int = 20) -> None:
    """Add rate samples to a history that keeps the last ``n`` of each extractor and bucket, whatever was ever added.

    The old samples of the extractors that have new ones are read, merged and written over; others aren't touched.
    """
    spark = rates.sparkSession
    new = rates.select("extractor", "bucket", "rate", "started_at", "idx")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        old = spark.read.schema(new.schema).parquet(path)
        new = old.join(new.select("extractor").distinct(), "extractor", "left_semi").select(*new.columns).unionByName(new)
    checkpoint_dir(spark)
    kept = last_rates(new, n).select(*new.columns).checkpoint()  # before the files that it reads are replaced
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("extractor").parquet(path)


def load_rates(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """The last ``n`` samples per extractor and bucket."""
    return last_rates(spark.read.parquet(path), n)
