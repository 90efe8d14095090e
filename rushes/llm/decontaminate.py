"""Benchmark decontamination by winnowing.

A window is ``n`` consecutive words.  Of the hashes of its ``k``-word grams it keeps the least, its fingerprint; equal
windows have equal fingerprints, so joining the fingerprints of training and benchmark texts meets every shared run of
at least ``n`` words.  Below a shared fingerprint the windows around it are compared word by word, and overlapping
windows add up to the whole shared run.  A benchmark text of fewer than ``n`` words is one window of its own length,
whose fingerprint is the hash of all its words.

The fingerprints of the benchmark go to the executors as a bitmap of a fixed greatest size, so that documents shuffle
only windows that may be shared; a full bitmap lets more through and changes no result.  A window shared by many items
meets a document once: sets of items are named by a digest and expanded once for each distinct combination.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushes.llm.common import bit_set, text_key, without, written
from rushes.llm.words import ALNUM, LOWER, grams, words

MAX_BITS = 1 << 27

_WINDOW = "item_id string, size int, fp long, words string"
_FOUND = "doc_id long, text_key long, n_words long, at long, size int, fp long, words string"


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` consecutive hashes."""
    out = h[: len(h) - width + 1].copy()
    for j in range(1, width):
        np.minimum(out, h[j : len(h) - width + 1 + j], out=out)
    return out


def _said(w, i: int, size: int, low: np.ndarray) -> str:
    return b" ".join(low[w.start[j] : w.end[j]].tobytes() for j in range(i, i + size)).decode()


def _starts(w, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all n-word windows, and their fingerprints."""
    if len(w.hash) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g, _ = grams(w, k)
    least = _least(g[: len(g) - k + 1], n - k + 1)
    at = np.flatnonzero(w.doc[: len(least)] == w.doc[n - 1 :])
    return at, least[at]


def _benchmark_windows(n: int, k: int):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for w in words(b.column(1)):
                low, rows = LOWER[w.data], []
                at, fp = _starts(w, n, k)
                for i, f in zip(at.tolist(), fp.view(np.int64).tolist()):
                    rows.append((ids[w.first + w.doc[i]], n, f, _said(w, i, n, low)))
                first = np.cumsum(w.counts) - w.counts
                for d in np.flatnonzero((w.counts > 0) & (w.counts < n)).tolist():
                    m, i = int(w.counts[d]), int(first[d])
                    rows.append((ids[w.first + d], m, int(grams(w, m)[0].view(np.int64)[i]), _said(w, i, m, low)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.string(), pa.int32(), pa.int64(), pa.string()))],
                    names=["item_id", "size", "fp", "words"],
                )

    return run


def _document_windows(n: int, k: int, sizes: list[int], bits: int, bitmap):
    def run(batches):
        have, mask = bitmap.value, np.uint64(bits - 1)

        def may(h):
            slot = h & mask
            return (have[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for b in batches:
            ids, keys = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            for w in words(b.column(2)):
                doc, at, size, fp, said = [], [], [], [], []
                low = None
                found = []
                if n in sizes:
                    i, h = _starts(w, n, k)
                    keep = may(h)
                    found.append((n, i[keep], h[keep]))
                for m in sizes:
                    if m < n:
                        h, ok = grams(w, m)
                        i = np.flatnonzero(ok)
                        i = i[may(h[i])]
                        found.append((m, i, h[i]))
                first = np.cumsum(w.counts) - w.counts
                for m, i, h in found:
                    if not len(i):
                        continue
                    low = LOWER[w.data] if low is None else low
                    doc.append(w.doc[i])
                    at.append(i - first[w.doc[i]])
                    size.append(np.full(len(i), m))
                    fp.append(h)
                    said += [_said(w, j, m, low) for j in i.tolist()]
                # one row a text that carries its number of words, dealt by its own key
                t = len(w.counts)
                doc = np.concatenate([np.arange(t), *doc]).astype(np.int64)
                here = keys[w.first : w.first + t]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(doc + w.first)), pa.array(here[doc]), pa.array(w.counts[doc].astype(np.int64)),
                        pa.array(np.concatenate([np.full(t, -1), *at]).astype(np.int64)),
                        pa.array(np.concatenate([np.zeros(t), *size]).astype(np.int32)),
                        pa.array(np.concatenate([here, *(x.view(np.int64) for x in fp)])),
                        pa.array([None] * t + said, pa.string()),
                    ],
                    names=["doc_id", "text_key", "n_words", "at", "size", "fp", "words"],
                )

    return run


def benchmark_windows(benchmark: DataFrame, n: int = 10, k: int = 5) -> DataFrame:
    """(item_id, size, fp, words): the distinct windows of every item.  An item without words has none."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null").mapInArrow(_benchmark_windows(n, k), _WINDOW)
    return rows.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, n_words, spans, n_hit, n_items, items_sha256, contaminated.

    ``spans`` lists the shared runs as (first word, words), merged where they overlap.  Null and empty texts have no
    words, no spans and the digest of the empty string.  Repeated rows give repeated, equal results; a null ``doc_id``
    is a value like any other; an item without id counts for nothing.  Only doc_id and text of ``docs`` and item_id
    and text of ``benchmark`` are read, so other columns may have any name.  Empty tables give no rows or no spans.
    """
    if not 1 <= k <= n:
        raise ValueError("k must lie between 1 and n")
    spark = docs.sparkSession
    listed = written(benchmark_windows(benchmark, n, k), "windows")
    # The set of items of a window, named without collecting it.
    h = F.xxhash64("item_id").cast("decimal(20,0)")
    named = listed.groupBy("size", "fp", "words").agg(
        F.concat_ws(":", F.count("*").cast("string"), F.sum(h).cast("string"), F.sum(F.xxhash64("item_id", F.lit(1)).cast("decimal(20,0)")).cast("string")).alias("items")
    )
    named = written(named, "items")
    facts = named.groupBy("size").count().collect()  # at most n rows
    sizes, total = [r["size"] for r in facts], sum(r["count"] for r in facts)
    bits = min(MAX_BITS, 1 << max(15, (16 * total).bit_length()))
    bitmap = spark.sparkContext.broadcast(bit_set(named, "fp", bits))
    found = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text").mapInArrow(
        _document_windows(n, k, sizes, bits, bitmap), _FOUND
    )
    met = found.join(named, ["fp", "size", "words"], "left").select(
        "doc_id", "text_key", "n_words", "at", "size", "items", (F.col("at") < 0).alias("is_text")
    )
    hit = F.when(F.col("items").isNotNull(), F.struct("at", (F.col("at") + F.col("size")).alias("to")))
    per_doc = met.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.sum(F.col("is_text").cast("int")).alias("copies"),
        F.sort_array(F.collect_set(hit)).alias("hits"), F.sort_array(F.collect_set("items")).alias("sets"),
    )
    merged = F.aggregate(
        "hits", F.expr("array(named_struct('at', -1L, 'to', -1L))"),
        lambda acc, x: F.when(
            x["at"] <= F.element_at(acc, -1)["to"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["at"].alias("at"), F.greatest(F.element_at(acc, -1)["to"], x["to"]).alias("to")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    per_doc = written(per_doc.withColumn("sets", F.when(F.size("sets") > 0, F.concat_ws(",", "sets"))), "hits")
    # Each distinct combination of item sets is expanded once.
    one = named.groupBy("items").agg(F.min(F.struct("size", "fp", "words")).alias("w")).select("items", "w.*")
    members = listed.join(one, ["size", "fp", "words"]).select("items", "item_id")
    combos = per_doc.select("sets").where("sets is not null").distinct()
    digests = (
        combos.select("sets", F.explode(F.split("sets", ",")).alias("items")).join(members, "items").select("sets", "item_id").distinct()
        .groupBy("sets").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
        .select("sets", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    )
    spans = F.expr("transform(slice(merged, 2, size(merged)), x -> named_struct('at', x.at, 'words', x.to - x.at))")
    return (
        per_doc.join(digests, "sets", "left").withColumn("merged", merged).withColumn("spans", spans)
        .select(
            F.explode(F.expr("sequence(1, copies)")).alias("copy"), "doc_id", "text_key", "n_words", "spans",
            F.expr("aggregate(spans, 0L, (a, x) -> a + x.words)").alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        )
        .drop("copy").withColumn("contaminated", F.col("n_hit") > 0)
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 5) -> DataFrame:
    """``docs`` without the documents that share a window with the benchmark; all columns stay as they are, whatever their names.

    Documents without words stay, and so do all if the benchmark is empty; repeated rows go or stay together.  An empty
    table stays empty.
    """
    bad = decontaminate(docs.select("doc_id", "text"), benchmark, n, k).where("contaminated").select("doc_id", "text_key").distinct()
    return without(docs, written(bad, "contaminated"))
