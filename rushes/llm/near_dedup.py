"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles, banded and verified.

A shingle is five consecutive words (all words of a shorter text); it weighs its count in the text times the mean
inverse document frequency of its words.  Document frequencies are counted over all documents in ``DF_SLOTS`` slots of
hashed words, a table whose size doesn't depend on the corpus.

Improved consistent weighted sampling draws, from the weights of a text, ``BANDS * ROWS`` samples, each equal in two
texts with a probability of their weighted Jaccard similarity: at 0.8, one of the bands agrees with 0.9994.  Texts that
agree in a band are measured exactly: first every text of a band against the one of them that meets most texts, which
settles groups of copies in linear work; then, where that left a band in several classes, all pairs of those texts that
prefix filtering by rare shingles leaves open.  Classes are the components of the links of ``threshold`` or more.

Equal texts count once throughout, so thousands of exact copies cost no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushes.llm.common import bit_set, components, discard, only, rows_per_batch, text_key, without, written
from rushes.llm.words import ALNUM, Words, grams, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
DF_SLOTS = 1 << 18
#: What the most frequent words weigh.  It keeps the weighted similarity near the plain one, so that a few new words don't
#: part the copies of a text that makes up much of the corpus.
IDF_FLOOR = 8.0
MAX_BITS = 1 << 27
SETS_PER_BATCH = 100

_TABLE = 1 << 16


class _Draws:
    """The random numbers of the sampling, by hashed shingle: gamma(2, 1) twice and a uniform one."""

    made = None

    @classmethod
    def get(cls):
        if cls.made is None:
            rng = np.random.default_rng(71)
            r, c, beta = rng.gamma(2, 1, _TABLE), rng.gamma(2, 1, _TABLE), rng.random(_TABLE)
            cls.made = tuple(x.astype(np.float32) for x in (r, 1 / r, np.log(c) - r, beta))
        return cls.made


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def weighted_shingles(w: Words, idf: np.ndarray, k: int = SHINGLE):
    """Texts, hashes and weights of the distinct shingles, in ascending order of text and hash."""
    c = np.concatenate([[0.0], np.cumsum(idf[slots(w.hash)], dtype=np.float64)])
    first = np.cumsum(w.counts) - w.counts
    parts = []
    for m in range(1, k + 1):
        h, ok = grams(w, m)
        i = np.flatnonzero(ok) if m == k else first[w.counts == m]
        if len(i):
            parts.append((w.doc[i], h[i], (c[i + m] - c[i]) / m))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    doc, h, idf_mean = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h, doc))
    doc, h, idf_mean = doc[order], h[order], idf_mean[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    tf = np.diff(np.append(at, len(h)))
    return doc[at], h[at], (tf * idf_mean[at]).astype(np.float32)


def sample(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` consistent weighted samples of each text, as 32-bit values; the texts come first."""
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    r_of, inverse, c_less_r, beta_of = _Draws.get()
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    own = low * np.uint32(0x9E3779B1) + high
    log_weight = np.log(weight).astype(np.float32)
    out = np.empty((len(at), n), np.uint32)
    for j in range(n):
        i = ((low + np.uint32(j + 1) * high) >> np.uint32(16)).astype(np.intp)
        r, beta = r_of[i], beta_of[i]
        t = np.floor(log_weight * inverse[i] + beta)
        a = (c_less_r[i] - r * (t - beta)).view(np.int32)
        a = a ^ ((a >> 31) & np.int32(0x7FFFFFFF))  # sorts as the floats do
        key = (a.astype(np.int64) << 32) | (own + t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA6B))
        out[:, j] = (np.minimum.reduceat(key, at) & 0xFFFFFFFF).astype(np.uint32)
    return doc[at], out


def _count_words(batches):
    df, n = np.zeros(DF_SLOTS, np.int64), 0
    for b in batches:
        n += len(b)
        for w in words(b.column(0), ALNUM):
            seen = np.unique(w.doc.astype(np.int64) * DF_SLOTS + slots(w.hash))
            df += np.bincount(seen & (DF_SLOTS - 1), minlength=DF_SLOTS)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["slot", "df"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF_FLOOR + ln((1 + documents) / (1 + document frequency)) by slot: ``DF_SLOTS`` numbers, counted over all documents."""
    rows = docs.select("text").mapInArrow(_count_words, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(DF_SLOTS), 0
    for r in rows:
        if r["slot"] < 0:
            n = r["df"]
        else:
            df[r["slot"]] = r["df"]
    return (IDF_FLOOR + np.log((1 + n) / (1 + df))).astype(np.float32)


def _bands(idf, rows: int, bands: int):
    def run(batches):
        for b in batches:
            for w in words(b.column(1), ALNUM):
                doc, values = sample(*weighted_shingles(w, idf.value), rows * bands) if len(w.hash) else (np.zeros(0, np.int32), np.zeros((0, rows * bands), np.uint32))
                key = np.zeros((len(doc), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
                for j in range(rows):
                    key = (key ^ values[:, j::rows]) * np.uint64(0x9FB21C651E98DF25)
                    key ^= key >> np.uint64(28)
                ids = b.column(0).take(pa.array(np.repeat(doc.astype(np.int64) + w.first, bands)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key.reshape(-1).view(np.int64))], names=["text_id", "band"])

    return run


def _sets(idf, wanted, bits: int):
    def run(batches):
        have, sent = wanted.value, set()
        for b in batches:
            slot = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
            keep = np.flatnonzero((have[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            ids = b.column(0).take(pa.array(keep)).to_pylist()
            new = []
            for i, t in zip(keep.tolist(), ids):
                if t not in sent:
                    sent.add(t)
                    new.append(i)
            if not new:
                continue
            part = b.take(pa.array(new))
            for w in words(part.column(2), ALNUM):
                doc, h, weight = weighted_shingles(w, idf.value)
                at = np.searchsorted(doc, np.arange(len(w.counts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(w.first, len(w.counts)), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(weight)),
                    ],
                    names=["text_id", "shingles", "weights"],
                )

    return run


def _similar(batches):
    for b in batches:
        ends = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in map(b.column, range(2, 6))]
        out = np.zeros(len(b))
        for i in range(len(b)):
            ha, wa, hb, wb = (v[o[i] : o[i + 1]] for o, v in ends)
            at = np.searchsorted(hb.view(np.uint64), ha.view(np.uint64))
            at[at == len(hb)] = 0
            both = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
            shared = np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64)
            total = wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - shared
            out[i] = shared / total if total else 0.0
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["a", "b", "similarity"])


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their weighted Jaccard similarity."""
    one = sets.select(F.col("text_id").alias("a"), F.col("shingles").alias("ha"), F.col("weights").alias("wa"))
    two = sets.select(F.col("text_id").alias("b"), F.col("shingles").alias("hb"), F.col("weights").alias("wb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "wa", "hb", "wb")
    return both.mapInArrow(_similar, "a binary, b binary, similarity double")


def _count_shingles(batches):
    for b in batches:
        slot, n = np.unique(slots(b.column(0).values.to_numpy().view(np.uint64)) if len(b) else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "n"])


def _prefixes(order, threshold: float):
    def run(batches):
        short = (1 - threshold) / (1 + threshold)
        for b in batches:
            offsets, h, weight = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(), b.column(3).values.to_numpy()
            frequency, parts = order.value[slots(h.view(np.uint64))], []
            for i in range(len(b)):
                lo, hi = offsets[i], offsets[i + 1]
                if hi == lo:
                    continue
                rank = np.lexsort((h[lo:hi], frequency[lo:hi]))
                held = np.cumsum(weight[lo:hi][rank], dtype=np.float64)
                total = held[-1]
                before = np.concatenate([[0.0], held[:-1]])
                n = int(np.searchsorted(before, (1 - threshold) * total * (1 + 1e-6), "right"))
                parts.append((np.full(n, i), h[lo:hi][rank[:n]], total - before[:n], np.full(n, total), before[:n] <= short * total * (1 + 1e-6)))
            if parts:
                who, what, rest, total, first = (np.concatenate(x) for x in zip(*parts))
                who = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(who), b.column(1).take(who), pa.array(what), pa.array(rest), pa.array(total), pa.array(first)],
                    names=["text_id", "component", "shingle", "rest", "total", "first"],
                )

    return run


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of ``sets`` in different components that can reach the threshold.

    In one order of all shingles, rare ones first, two texts of the threshold t share a shingle among the first ones: those
    before which the lighter text has at most (1 - t) / (1 + t) of its weight and the heavier one 1 - t.  What both have
    from the first shared shingle on must be enough.  A text whose own shingles weigh more than that share has no partner
    in its group, however large the group.
    """
    rows = sets.select("shingles").mapInArrow(_count_shingles, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(DF_SLOTS, np.int64)  # at most DF_SLOTS rows
    for r in rows:
        frequency[r["slot"]] = r["n"]
    order = sets.sparkSession.sparkContext.broadcast(frequency)
    firsts = written(
        sets.select("text_id", "component", "shingles", "weights").mapInArrow(
            _prefixes(order, threshold), "text_id binary, component binary, shingle long, rest double, total double, first boolean"
        ),
        "prefixes",
    )
    by_class = firsts.groupBy("shingle", "component").agg(F.count("*").alias("n"), F.max(F.col("first").cast("int")).alias("first"))
    mixed = by_class.groupBy("shingle").agg(F.count("*").alias("classes"), F.max("first").alias("first"), F.max(F.struct("n", "component")).alias("top")).where("classes > 1 and first = 1")
    held = written(firsts.join(mixed.select("shingle", F.col("top.component").alias("largest")), "shingle"), "mixed")
    discard(firsts)
    light = held.where("first").select("shingle", "largest", F.col("text_id").alias("a"), F.col("component").alias("ca"), F.col("rest").alias("ra"), F.col("total").alias("wa"))
    heavy = held.select("shingle", F.col("text_id").alias("b"), F.col("component").alias("cb"), F.col("rest").alias("rb"), F.col("total").alias("wb"), "largest")
    enough = (
        (F.struct("wa", "a") < F.struct("wb", "b")) & (F.col("ca") != F.col("cb")) & (F.col("wa") >= threshold * F.col("wb") * (1 - 1e-6))
        & (F.least("ra", "rb") >= threshold / (1 + threshold) * (F.col("wa") + F.col("wb")) * (1 - 1e-6))
    )
    small = light.where("ca <> largest").join(heavy.drop("largest"), "shingle").where(enough)
    large = light.where("ca = largest").drop("largest").join(heavy.where("cb <> largest").drop("largest"), "shingle").where(enough)
    pairs = written(small.select("a", "b").unionByName(large.select("a", "b")).distinct(), "pairs")
    discard(held)
    return pairs


def stars(shared: DataFrame) -> DataFrame:
    """(band, a, b): each text b of a band with the band's leader a; ``shared`` has (band, text_id, n), n texts in the band."""
    # The text that meets most others leads each of its bands: the text that a group's copies were made from.
    central = shared.groupBy("text_id").agg(F.sum("n").alias("met"))
    leaders = shared.join(central, "text_id").groupBy("band").agg(F.max(F.struct("met", "text_id")).alias("top")).select("band", F.col("top.text_id").alias("a"))
    return shared.join(leaders, "band").select("band", "a", F.col("text_id").alias("b"))


def resolve(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): the links of ``threshold`` or more that join the classes, from stars and their open rests."""
    spark = met.sparkSession
    starred = _measured(met.where("a <> b").select("a", "b").distinct(), sets)
    with rows_per_batch(spark, SETS_PER_BATCH):
        joined = written(starred.where(F.col("similarity") >= threshold), "stars")
    classes = components(joined.select("a", "b"))
    placed = met.join(classes.withColumnRenamed("node", "b"), "b", "left").select("band", F.col("b").alias("text_id"), F.coalesce("component", "b").alias("component"))
    open_bands = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
    unsettled = placed.join(open_bands, "band", "left_semi").select("text_id", "component").distinct()
    with rows_per_batch(spark, SETS_PER_BATCH):
        unsettled = written(sets.join(unsettled, "text_id"), "unsettled")
        more = _prefix_pairs(unsettled, threshold)
        rest = written(_measured(more, unsettled).where(F.col("similarity") >= threshold), "rest")
        discard(unsettled, more)
    return joined.unionByName(rest)


def links(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, similarity): verified links between different texts (named by their MD5) that join all of each class."""
    spark = docs.sparkSession
    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_id"), "text")
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
    banded = written(texts.mapInArrow(_bands(idf, rows, bands), "text_id binary, band long").distinct(), "bands")
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(banded.join(sizes, "band"), "shared")
    discard(banded)
    met = written(stars(shared), "met")
    discard(shared)
    nodes = met.select(F.xxhash64("b").alias("slot")).distinct()
    bits = min(MAX_BITS, 1 << max(15, (16 * nodes.count()).bit_length()))
    wanted = spark.sparkContext.broadcast(bit_set(nodes, "slot", bits))
    keyed = texts.select("text_id", F.xxhash64("text_id").alias("slot"), "text")
    sets = written(
        keyed.mapInArrow(_sets(idf, wanted, bits), "text_id binary, shingles array<long>, weights array<float>").dropDuplicates(["text_id"]), "sets"
    )
    found = resolve(met, sets, threshold)
    discard(met, sets)
    return found


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, class_id, class_size, kept.

    ``class_id`` is the least doc_id of the class (null before all others), ``class_size`` the rows in it, and ``kept``
    marks the row that stays: the least doc_id, then the least text hash.  Equal texts are always one class, null being
    the empty text; texts without words are like no other text.  Rows that repeat both doc_id and text are copies of
    each other, get equal results and are to be told apart by ``drop_near_duplicates``.  Only doc_id and text are read.
    An empty table gives no rows.
    """
    found = links(docs, threshold, bands, rows)
    classes = written(components(found.select("a", "b")), "classes")
    rows_ = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_id"))
    named = rows_.join(classes.withColumnRenamed("node", "text_id"), "text_id", "left").select("doc_id", "text_key", F.coalesce("component", "text_id").alias("component"))
    named = written(named, "named")
    heads = named.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("head"), F.count("*").alias("class_size"))
    return named.join(heads, "component").select(
        "doc_id", "text_key", F.col("head.doc_id").alias("class_id"), "class_size", F.struct("doc_id", "text_key").eqNullSafe(F.col("head")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class; all columns stay as they are, whatever their names.

    Null and empty texts are one class.  Of rows that repeat both doc_id and text one stays.  An empty table stays empty.
    """
    found = near_duplicates(docs.select("doc_id", "text"), threshold).groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    touched = written(found.where("not kept or n > 1"), "touched")
    repeated = written(touched.where("kept"), "repeated")
    key = next(f"_text_{i}" for i in range(len(docs.columns) + 1) if f"_text_{i}" not in docs.columns)
    once = only(docs, repeated).withColumn(key, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", key]).drop(key)
    return without(docs, touched).unionByName(once)
