"""Line dedup by winnowing over line digests, in DataFrame operations only.

Lines are the pieces between line feeds; those that are blank count for nothing.  From every line on, the fewest
lines that hold ``min_chars`` characters together are a window.  A window keeps the least digest of its lines as its
fingerprint.  Equal windows have equal fingerprints, so every run of lines of ``min_chars`` characters or more that
occurs twice shows as a fingerprint with two positions.  From those fingerprints matches grow in both directions: each
window around a shared fingerprint is compared with the others of equal lines, the first one stays, and overlapping
windows add up.  Where a run ends with lines that hold fewer characters together, no window from those lines on is full;
``whole`` adds the fewest lines up to every line that hold ``min_chars`` characters.  In a run of that many characters, the
windows from its lines on reach from its first line at least to where the last of them ends, and the window up to its last line begins at or
before that one's first line, so both kinds together cover exactly the lines of all repeated runs.

A frequent line does no harm: counts and first places are combined before the shuffle, and positions meet one row, the
first place, not each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rushes.llm.common import text_key, written

_KEY = ["doc_id", "text_key"]


def _windows(docs: DataFrame, min_chars: int, whole: bool) -> DataFrame:
    """(doc_id, text_key, no, last_no, fp, at, lines): every full window, its fingerprint and that line's number."""
    lines = (
        docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
        .where(F.trim("line") != "")
        .select(*_KEY, "no", F.unhex(F.md5(F.col("line").cast("binary"))).alias("digest"), F.length("line").cast("long").alias("size"))
        .repartition(*_KEY).dropDuplicates([*_KEY, "no"])
    )
    inside = Window.partitionBy(*_KEY).orderBy("no")
    placed = lines.withColumn("start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    ahead = Window.partitionBy(*_KEY).orderBy("start").rangeBetween(0, min_chars - 1)

    def seen(frame):
        low = F.min(F.struct("digest", "no")).over(frame)
        return F.struct(
            F.min("no").over(frame).alias("no"), F.max("no").over(frame).alias("last_no"), F.sum("size").over(frame).alias("held"), low.alias("low"),
            F.collect_list("digest").over(frame).alias("lines"),
        )

    full = seen(ahead).alias("w")
    if whole:
        back = Window.partitionBy(*_KEY).orderBy("stop").rangeBetween(1 - min_chars, 0)
        both = placed.withColumn("stop", F.col("start") + F.col("size")).select(*_KEY, "size", full, seen(back).alias("b"))
        # a window up to a line that is full without it holds a window from its first line on, and other lines than any of those
        more = F.when(F.col("b.held") - F.col("size") >= min_chars, F.array("w", "b")).otherwise(F.array("w"))
        windows = both.select(*_KEY, F.explode(more).alias("w"))
    else:
        windows = placed.select(*_KEY, full)
    return windows.where(F.col("w.held") >= min_chars).select(*_KEY, "w.no", "w.last_no", F.col("w.low.digest").alias("fp"), F.col("w.low.no").alias("at"), "w.lines")


def repeated_lines(docs: DataFrame, min_chars: int = 40, whole: bool = False) -> DataFrame:
    """(doc_id, text_key, gone): for each text, the numbers of the lines that lie in a run seen before, from 0."""
    windows = written(_windows(docs, min_chars, whole), "line-windows")
    shared = windows.select("fp", *_KEY, "at").distinct().groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    met = windows.join(shared, "fp")
    place = F.struct("doc_id", "text_key", "no")
    first = met.groupBy("lines").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("lines", "first")
    later = met.join(first, "lines").where(~place.eqNullSafe(F.col("first")))
    return (
        later.select(*_KEY, F.explode(F.sequence("no", "last_no")).alias("no")).groupBy(*_KEY).agg(F.collect_set("no").alias("gone"))
    )


def _without(text: str, gone: str) -> Column:
    """The text without the lines numbered in ``gone``; the split text is bound once."""
    kept = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s) - 1), gone)
    return F.element_at(F.transform(F.array(F.split(text, "\n", -1)), lambda s: F.array_join(F.transform(kept(s), lambda i: s[i]), "\n")), 1)


def line_dedup(docs: DataFrame, min_chars: int = 40, whole: bool = False) -> DataFrame:
    """``docs`` with shortened ``text``, and new columns ``n_lines`` and ``n_removed``.

    A line goes if it lies in a run of consecutive lines, blank ones apart, of at least ``min_chars`` characters that
    occurs earlier: in a smaller doc_id (null first), or further up in the same text.  Without ``whole``, last lines of such
    a run stay if no window from a line on covers them.  Everything else stays, blank
    lines included.  Null and empty texts stay as they are, with 0 lines.  Rows that repeat both doc_id and text
    count as one and get equal results; texts that share a doc_id are ordered by their hash.  Other columns pass
    through; ``docs`` must not have ``n_lines``, ``n_removed`` or names that begin with ``_dedup_``.  An empty table
    gives no rows.
    """
    gone = repeated_lines(docs, min_chars, whole).select(F.col("doc_id").alias("_dedup_id"), F.col("text_key").alias("_dedup_key"), F.col("gone").alias("_dedup_gone"))
    keyed = docs.withColumn("_dedup_own", text_key())
    both = keyed.join(gone, keyed["doc_id"].cast("long").eqNullSafe(gone["_dedup_id"]) & (keyed["_dedup_own"] == gone["_dedup_key"]), "left")
    some = F.col("_dedup_gone").isNotNull()
    return (
        both.withColumn("n_lines", F.when(F.length("text") > 0, F.regexp_count("text", F.lit("\n")) + 1).otherwise(0).cast("long"))
        .withColumn("n_removed", F.when(some, F.size("_dedup_gone")).otherwise(0).cast("long"))
        .withColumn("text", F.when(some, _without("text", "_dedup_gone")).otherwise(F.col("text")))
        .drop("_dedup_id", "_dedup_key", "_dedup_gone", "_dedup_own")
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """``docs`` after ``line_dedup`` of whole runs: documents of which nothing but blank lines is left go, as all of it stands in others."""
    out = line_dedup(docs, min_chars, whole=True).where("n_removed = 0 or trim(translate(text, '\n', ' ')) <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
