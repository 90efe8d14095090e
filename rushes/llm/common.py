"""What several operators share: row keys, tables that cut lineage, connected components, shared sets."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rushes.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column = "text") -> Column:
    """Tells texts of one ``doc_id`` apart; together they name a row, and equal rows share their decisions."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def same_row(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("doc_id", "text_key")) -> Column:
    """Null-safe equality on the columns that name a row."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: lost executors cost no recomputation, and plans start here."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Shuffle files of finished jobs go with the driver's garbage, which a driver that only plans seldom collects.
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once everything that reads them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of two numbers that may be broadcast: at most 32 MB.
FEW = 1 << 20


def few(df: DataFrame) -> DataFrame:
    """A table that ``written`` made, to be broadcast if it has at most ``FEW`` rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= FEW else df


def _keyed_by(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    named = few(keys).select(F.col("doc_id").alias("_key_doc"), F.col("text_key").alias("_key_text"))
    return docs.join(named, docs["doc_id"].cast("long").eqNullSafe(named["_key_doc"]) & text_key(docs["text"]).eqNullSafe(named["_key_text"]), how)


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` less the rows of ``keys`` (doc_id, text_key); keeps all its columns, whatever their names, and shuffles no text for few keys."""
    return _keyed_by(docs, keys, "left_anti")


def only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keys`` (doc_id, text_key) names."""
    return _keyed_by(docs, keys, "left_semi")


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """What runs inside hands Python at most ``rows`` rows at a time: for rows that hold long arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its smallest node.

    Alternates the two star contractions: neighbours above a node, then those below, move to the smallest neighbour.
    Each step is a minimum by key (combined before the shuffle) and a join, so no neighbourhood is ever collected.
    """
    checkpoint_dir(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = small.where("u <> v").distinct().checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def bit_set(values: DataFrame, column: str, bits: int):
    """A bitmap of ``bits`` positions as numpy bytes, at most ``bits / 8`` bytes whatever the table holds."""
    import numpy as np

    slot = F.pmod(F.col(column), F.lit(bits)) + 1
    rows = (
        values.select(F.bitmap_bucket_number(slot).alias("n"), F.bitmap_bit_position(slot).alias("p"))
        .groupBy("n").agg(F.bitmap_construct_agg("p").alias("b")).collect()
    )
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in rows:
        out[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(r["b"], np.uint8)
    return out
