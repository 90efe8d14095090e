"""Repeated passages: paragraphs by MinHash banding, verified, clustered, and removed but for their first place.

A paragraph here is a piece that copies keep whole wherever they are put: a line, cut after sentences of ``SHORT`` words
or more; lines below ``SHORT`` words that follow each other count as one.  Where that leaves ``LONG`` words or more without
a cut, be it one sentence or many short ones, they are cut as well after each word whose hash is the least of the ``NEAR``
words to either side in its text.  Pieces below ``SHORT`` words are not compared.  Each has ``BANDS`` bands of one MinHash of its five-word shingles: paragraphs with a Jaccard similarity of 0.8
meet in one with 0.992.  Those that meet are verified by their exact similarity and clustered by components.

Paragraphs of a cluster after the first one are repeats.  A repeat grows word by word to both sides, by ``CONTEXT`` words
at most, as long as the words are those around the first one, since a passage may begin or end inside a paragraph.
Overlapping repeats form a passage; passages of at least ``MIN_WORDS`` words are reported, shorter ones are left as common
phrases.  A shared run of 51 words that holds a whole paragraph is thus always long enough.

Most paragraphs occur once.  A first pass counts band keys; a bitmap of fixed greatest size tells the second pass which
keys are shared, so that only paragraphs that may be repeats are shuffled with their shingles.  A full bitmap lets more
through and changes no result.  Shingles of a paragraph are compared by 32 bits, the words around it by 8.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rushes.llm.common import bit_set, components, text_key, written
from rushes.llm.near_dedup import resolve, stars
from rushes.llm.words import NONBLANK, Words, grams, mix, spread, words

BANDS = 3
SHORT, LONG, NEAR = 8, 24, 7
MIN_WORDS = 30
CONTEXT = 24
THRESHOLD = 0.8
MAX_BITS = 1 << 27

_STOPS = np.zeros(256, bool)
_STOPS[[46, 33, 63]] = True


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of every paragraph."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    feeds = np.concatenate([[0], np.cumsum(w.data == 10, dtype=np.int32)])
    over, line = np.ones(n, bool), np.ones(n, bool)
    over[:-1] = w.doc[1:] != w.doc[:-1]
    line[:-1] = (feeds[w.start[1:]] > feeds[w.end[:-1]]) | over[:-1]
    feed = np.flatnonzero(line)
    short = np.diff(feed, prepend=-1) < SHORT
    line[feed[:-1][short[:-1] & short[1:] & ~over[feed[:-1]]]] = False
    ends = np.flatnonzero(line | _STOPS[w.data[w.end - 1]])
    stop = np.zeros(n, bool)
    stop[ends] = line[ends] | (np.diff(ends, prepend=-1) >= SHORT)
    sizes = np.diff(np.flatnonzero(stop), prepend=-1)
    least = np.repeat(sizes, sizes) >= LONG
    for j in range(1, min(NEAR, n - 1) + 1):
        near, a, b = w.doc[j:] == w.doc[:-j], w.hash[:-j], w.hash[j:]
        least[j:] &= ~(near & (a < b))
        least[:-j] &= ~(near & (b < a))
    ends = np.flatnonzero(stop | least)
    cut = ends[line[ends] | (np.diff(ends, prepend=-1) >= SHORT)]
    return np.concatenate([[0], cut[:-1] + 1]), cut


def _hashed(w: Words, first: np.ndarray, last: np.ndarray):
    """Hash and MinHash keys of each paragraph, and the shingle hashes of all words."""
    inside = np.arange(len(w.hash)) - np.repeat(first, last - first + 1)
    own = np.add.reduceat(mix(w.hash + inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
    g, _ = grams(w, 5)
    past = inside > np.repeat(last - first - 4, last - first + 1)
    keys = np.empty((len(first), BANDS), np.uint64)
    for j in range(BANDS):
        v = spread(g, j + 1)
        v[past] = np.uint64(0xFFFFFFFFFFFFFFFF)
        keys[:, j] = mix(np.minimum.reduceat(v, first) + np.uint64(j))
    return mix(own), keys, g


def _keys(batches):
    for b in batches:
        parts = []
        for w in words(b.column(0), NONBLANK):
            first, last = paragraphs(w)
            if len(first):
                own, keys, _ = _hashed(w, first, last)
                keep = last - first + 1 >= SHORT
                parts.append((own[keep], keys[keep]))
        own, keys = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros((0, BANDS), np.uint64))
        own, at, n = np.unique(own, return_index=True, return_counts=True)
        keys, m = np.unique(keys[at].reshape(-1), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, keys]).view(np.int64)), pa.array(np.concatenate([n, m]))], names=["band", "n"])


def _second(h: np.ndarray) -> np.ndarray:
    """The other place of a key in the bitmap."""
    return (h >> np.uint64(32)) | (h << np.uint64(32))


_FOUND = (
    "doc_id long, text_key long, first int, last int, before binary, after binary, text_id binary, bands array<long>, shingles array<int>"
)


def _flagged(bitmap, bits: int):
    def run(batches):
        have, mask, sent = bitmap.value, np.uint64(bits - 1), set()

        def place(slot):
            return (have[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

        def shared(h):
            return place(h & mask) & place(_second(h) & mask)

        for b in batches:
            ids, text_keys = b.column(0), b.column(1)
            for w in words(b.column(2), NONBLANK):
                first, last = paragraphs(w)
                if not len(first):
                    continue
                own, keys, g = _hashed(w, first, last)
                size = last - first + 1
                doc = w.doc[first]
                bands = shared(keys)
                at = np.flatnonzero((size >= SHORT) & (bands.any(1) | shared(own)))
                if not len(at):
                    continue
                short = np.maximum((w.hash >> np.uint64(56)).astype(np.uint8), 1)
                top, total = np.searchsorted(w.doc, doc[at]), w.counts[doc[at]]
                step = np.arange(1, CONTEXT + 1)
                back, ahead = first[at][:, None] - step, last[at][:, None] + step
                # nearest word first; zero beyond the text
                before = np.where(back >= top[:, None], short[np.maximum(back, 0)], 0).astype(np.uint8)
                after = np.where(ahead < (top + total)[:, None], short[np.minimum(ahead, len(short) - 1)], 0).astype(np.uint8)
                name = [x.tobytes() for x in own[at]]
                sets = []
                for i, x in zip(at.tolist(), name):
                    sets.append(None if x in sent else np.unique(g[first[i] : last[i] - 3].astype(np.uint32)).view(np.int32))
                    sent.add(x)
                take = pa.array(doc[at].astype(np.int64) + w.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take), text_keys.take(take), pa.array((first[at] - top).astype(np.int32)), pa.array((last[at] - top).astype(np.int32)),
                        pa.array([x.tobytes() for x in before], pa.binary()), pa.array([x.tobytes() for x in after], pa.binary()), pa.array(name, pa.binary()),
                        pa.array([keys[i][bands[i]].view(np.int64) for i in at], pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "text_key", "first", "last", "before", "after", "text_id", "bands", "shingles"],
                )

    return run


def _common(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many words from the nearest on are the same in two columns of contexts."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, CONTEXT) for c in (a, b))
    other = (x != y) | (x == 0)
    return np.where(other.any(1), other.argmax(1), CONTEXT)


def _grown(batches):
    for b in batches:
        if len(b):
            left, right = _common(b.column(4), b.column(6)), _common(b.column(5), b.column(7))
            first, last = (b.column(j).to_numpy().astype(np.int64) for j in (2, 3))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(first - left), pa.array(last + right), b.column(8)], names=["doc_id", "text_key", "first", "last", "of_doc_id"]
            )


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages that repeat: doc_id, text_key, first_word, n_words, n_paragraphs, of_doc_ids.

    Words are pieces without ASCII white space, counted from 0.  ``of_doc_ids`` are the documents with the first places
    of the passage's paragraphs; places go by doc_id (null first), text hash and position, so a text can repeat
    itself.  Null, empty and short texts have no passages.  Rows that repeat both doc_id and text count as one.  Only
    doc_id and text are read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    counted = docs.select("text").mapInArrow(_keys, "band long, n long").groupBy("band").agg(F.sum("n").alias("n"))
    shared = written(counted.where("n > 1").select("band"), "shared-bands")
    bits = min(MAX_BITS, 1 << max(15, (32 * shared.count()).bit_length()))
    other = F.call_function("shiftrightunsigned", F.col("band"), F.lit(32)).bitwiseOR(F.call_function("shiftleft", F.col("band"), F.lit(32)))
    bitmap = spark.sparkContext.broadcast(bit_set(shared.unionByName(shared.select(other.alias("band"))), "band", bits))
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    found = written(rows.mapInArrow(_flagged(bitmap, bits), _FOUND), "paragraphs")
    distinct = found.where("shingles is not null").dropDuplicates(["text_id"])
    sets = written(
        distinct.select("text_id", "bands", F.expr("transform(shingles, x -> shiftleft(bigint(x), 32))").alias("shingles"), F.expr("transform(shingles, x -> float(1))").alias("weights")),
        "paragraph-sets",
    )
    met = sets.select("text_id", F.explode("bands").alias("band"))
    sizes = met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    linked = resolve(written(stars(written(met.join(sizes, "band"), "meetings")), "met"), sets.drop("bands"), threshold)
    classes = written(components(linked.select("a", "b")), "classes")
    places = found.drop("bands", "shingles")
    placed = written(
        places.join(classes.withColumnRenamed("node", "text_id"), "text_id", "left").withColumn("cluster", F.coalesce("component", "text_id")).drop("component", "text_id"), "placed"
    )
    where = ["doc_id", "text_key", "first"]
    heads = placed.groupBy("cluster").agg(F.min(F.struct(*where, "before", "after")).alias("head"), F.count("*").alias("n")).where("n > 1")
    later = placed.join(heads, "cluster").where(~F.struct(*where).eqNullSafe(F.struct(*(F.col(f"head.{c}").alias(c) for c in where))))
    grown = later.select(
        "doc_id", "text_key", "first", "last", "before", "after", F.col("head.before").alias("b2"), F.col("head.after").alias("a2"), F.col("head.doc_id").alias("of_doc_id")
    ).mapInArrow(_grown, "doc_id long, text_key long, first long, last long, of_doc_id long")
    inside = Window.partitionBy("doc_id", "text_key").orderBy("first", "last")
    reach = F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    runs = grown.withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy("doc_id", "text_key", "run").agg(
            F.min("first").alias("first_word"), (F.max("last") - F.min("first") + 1).alias("n_words"), F.size(F.collect_set(F.struct("first", "last"))).cast("long").alias("n_paragraphs"),
            F.sort_array(F.collect_set("of_doc_id")).alias("of_doc_ids"),
        )
        .where(F.col("n_words") >= min_words).drop("run")
    )


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans (first word, words) and the white space after them."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for first, n in sorted(spans):
        out.append(text[done : at[first]])
        done = at[first + n]
    return "".join([*out, text[done:]])


def remove_passages(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` whose texts have lost their repeated passages; all columns stay."""
    spans = repeated_passages(docs.select("doc_id", "text"), threshold, min_words)
    gone = spans.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("_gone"))
    keyed = docs.withColumn("_k", text_key())
    both = keyed.join(gone, keyed["doc_id"].cast("long").eqNullSafe(gone["_d"]) & (keyed["_k"] == gone["_t"]), "left").select("_gone", *docs.columns)
    names, at = list(docs.columns), docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at + 1).to_pylist()
            for i, g in enumerate(b.column(0).to_pylist()):
                if g:
                    texts[i] = cut_words(texts[i], [(x["first_word"], x["n_words"]) for x in g])
            columns = list(b.columns[1:])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, docs.schema)
