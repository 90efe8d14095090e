"""Language-model scoring by context-tree weighting over bytes.

The next byte is eight binary choices; each choice has, in every context of the last 0 to ``depth`` bytes, counts of
zeros and ones and their Krichevsky-Trofimov estimate.  The probability that weighting gives to the counts of a context
mixes, half and half, its own estimate with the product of those of its longer contexts; so each context gets a weight
against the longer ones, and the choice's probability is mixed along the path over all depths.  A text starts in a
context of zero bytes and ends with the byte 0xFF, which UTF-8 doesn't use.

Runs of ``depth + 1`` bytes (grams) are counted over all texts; those that only texts to be scored have count zero.  Grams are
dealt by the last two bytes of their context, so that a task has all longer contexts of those two bytes and weighs them up
and down.  From the contexts of one byte and of none, which need sums over all tasks, the driver gets at most 65,280 rows.
The outcome is a table of every gram's log probability.

Beside it stands a smoothed unigram model of words.  Both are joined, not broadcast: only the most frequent words and grams,
``HEAD`` and ``GRAMS`` at most, go to the executors, and documents shuffle just their rarer ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushes.llm.common import discard, text_key, written
from rushes.llm.words import NONBLANK, text_bytes, words

DEPTH = 2
HEAD = 1 << 20
GRAMS = 1 << 21
END_BYTE = 255
END_TOKEN = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20
_GRAM, _WORD, _TEXT, _NODE = 0, 1, 2, 3


def held_out(doc_id: str = "doc_id") -> Column:
    """Texts that the models don't learn from: crc32 of the doc_id's digits divisible by 10; null counts as no digits."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def _coded(column, depth: int):
    """Pieces of whole texts: for each byte and each end, its gram as one number, and where texts begin and end.

    The last byte of the context is the highest and the byte itself the lowest, so that sorted grams are sorted by contexts
    of every length.
    """
    data, offsets = text_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1)
        lo, hi, t = int(offsets[i]), int(offsets[j]), j - i
        # room for zero bytes before and the end byte after each text
        buffer = np.zeros(hi - lo + (depth + 1) * t, np.uint8)
        bounds = offsets[i : j + 1] - lo
        starts = bounds[:-1] + (depth + 1) * np.arange(t)
        buffer[np.arange(hi - lo) + np.repeat((depth + 1) * np.arange(t) + depth, np.diff(bounds))] = data[lo:hi]
        buffer[bounds[1:] + (depth + 1) * np.arange(t) + depth] = END_BYTE
        code = np.zeros(len(buffer) - depth, np.int64)
        for k in range(1, depth + 1):
            code |= buffer[depth - k : len(buffer) - k].astype(np.int64) << (8 * (depth + 1 - k))
        code |= buffer[depth:]
        keep = np.ones(len(code), bool)
        for k in range(1, depth + 1):  # what reaches back over the end of the text before
            keep[starts[1:] - k] = False
        yield i, code[keep], bounds[:-1] + np.arange(t), bounds[1:] + np.arange(1, t + 1)
        i = j


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate([np.zeros(0), *counts]), minlength=len(k)).astype(np.int64)


def _count(depth: int):
    def run(batches):
        for b in batches:
            learn, keys, counts = b.column(1).to_numpy(zero_copy_only=False), [], []
            for i, code, start, end in _coded(b.column(0), depth):
                learned = np.repeat(learn[i : i + len(start)], end - start)
                k, n = np.unique(code[learned], return_counts=True)
                other = np.unique(code[~learned])
                keys += [k, other]
                counts += [n, np.zeros(len(other))]
            k, grams = _summed(keys, counts)
            hashes = [w.hash for w in words(b.column(0).filter(b.column(1)), NONBLANK)]
            h, n = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(k), _GRAM), np.full(len(h) + 1, _WORD)]).astype(np.int8)),
                    pa.array(np.concatenate([k, h.view(np.int64), [END_TOKEN.astype(np.int64)]])),
                    pa.array(np.concatenate([grams, n, [int(learn.sum())]])),
                ],
                names=["kind", "key", "n"],
            )

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 1/2, by the asymptotic series above 8."""
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        low[small] += np.log(y[small])
        y[small] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


_FEW = 1 << 12
_HALVES, _WHOLES = _lgamma(np.arange(_FEW) + 0.5), _lgamma(np.arange(_FEW) + 1.0)


def _lgamma_of(counts: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    """ln gamma of ``counts + more``, most of which are small."""
    out, many = table[np.minimum(counts, _FEW - 1)], counts >= _FEW
    if many.any():
        out[many] = _lgamma(counts[many] + more)
    return out


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(one) and ln of the probability of the counts, by Krichevsky and Trofimov."""
    n = zeros + ones
    own = _lgamma_of(zeros, _HALVES, 0.5) + _lgamma_of(ones, _HALVES, 0.5) - _lgamma_of(n, _WHOLES, 1.0) - math.log(math.pi)
    return (ones + 0.5) / (n + 1), np.where(n > 0, own, 0.0)


def _weigh(own: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weight of a context against its longer ones, and ln of the weighted probability."""
    both = np.logaddexp(own, longer)
    return np.exp(own - both), both - math.log(2)


def _levels(key: np.ndarray, n: np.ndarray, depth: int) -> dict[int, tuple]:
    """By length of context, ``depth`` to 1: contexts with next byte, sorted; their counts; where each is one level up."""
    levels = {}
    for d in range(depth, 0, -1):
        up = ((key >> 16) << 8) | (key & 255)  # without the byte that lies furthest back
        above, at = np.unique(up, return_inverse=True)
        levels[d] = key, n, at
        key, n = above, np.bincount(at, weights=n, minlength=len(above)).astype(np.int64)
    return levels


def _subtree(key: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple]]:
    """All contexts of two bytes and more that end in the same two bytes, of some such pairs, from their sorted grams.

    For each gram, the probability of each of its eight choices as mixed over contexts of two bytes and more, and for the
    nodes of contexts of one byte (byte and choice as one number) the zeros, ones and the sum of what longer contexts give.
    """
    levels, out, up = _levels(key, n, depth), np.empty((len(key), 8), np.float32), []
    for bit in range(8):
        shift, weights, deeper = 8 - bit, {}, None
        for d in range(depth, 0, -1):
            k, count, _ = levels[d]
            first = np.flatnonzero(np.concatenate([[True], np.diff(k >> shift) != 0]))
            node = np.cumsum(np.bincount(first, minlength=len(k))) - 1  # of each row
            total = np.add.reduceat(count, first)
            ones = np.add.reduceat(count * ((k >> (shift - 1)) & 1), first)
            longer = None if deeper is None else np.bincount(node[levels[d + 1][2][deeper[0]]], weights=deeper[1], minlength=len(first))
            if d == 1:
                at = k[first]
                up.append((((at >> 8) << 8) | (((at & 255) | 256) >> shift), total - ones, ones, longer))
                break
            p, own = _estimate(total - ones, ones)
            w, weighted = (np.ones(len(first)), own) if longer is None else _weigh(own, longer)
            weights[d], deeper = (w, p, node), (first, weighted)
        at, mixed, left = np.arange(len(key)), np.zeros(len(key)), np.ones(len(key))
        places = {depth: at}
        for d in range(depth, 2, -1):
            places[d - 1] = levels[d][2][places[d]]
        one = (key >> (shift - 1)) & 1 == 1
        for d in range(2, depth + 1):
            w, p, node = weights[d]
            of = node[places[d]]
            mixed += left * w[of] * np.where(one, p[of], 1 - p[of])
            left *= 1 - w[of]
        out[:, bit] = mixed
    return out, up


_TREE = "kind byte, key long, n long, ones long, longer double, choices binary"


def _grow(depth: int, rows: int = 1 << 18):
    """Weigh the contexts of a partition, some pairs of last bytes at a time; grams come sorted."""

    def grown(key, n):
        choices, up = _subtree(key, n, depth)
        none = lambda m: np.zeros(m, np.int64)
        m, at, zeros, ones, longer = len(key), *(np.concatenate(x) for x in zip(*up))
        u = len(at)
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), m, [None, pa.py_buffer(np.ascontiguousarray(choices))]).cast(pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(m, _GRAM), np.full(u, _NODE)]).astype(np.int8)), pa.array(np.concatenate([key, at])),
                pa.array(np.concatenate([n, zeros])), pa.array(np.concatenate([none(m), ones])), pa.array(np.concatenate([np.zeros(m), longer])),
                pa.concat_arrays([packed, pa.nulls(u, pa.binary())]),
            ],
            names=["kind", "key", "n", "ones", "longer", "choices"],
        )

    def run(batches):
        keys, counts, held = [], [], 0
        for b in batches:
            keys.append(b.column(0).to_numpy())
            counts.append(b.column(1).to_numpy())
            held += len(b)
            if held >= rows:
                key, n = np.concatenate(keys), np.concatenate(counts)
                pair = key >> (8 * (depth - 1))
                cut = int(np.searchsorted(pair, pair[-1]))
                if cut:
                    yield grown(key[:cut], n[:cut])
                keys, counts, held = [key[cut:]], [n[cut:]], len(key) - cut
        if held:
            yield grown(np.concatenate(keys), np.concatenate(counts))

    return run


def _top(nodes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts of one byte, by byte and choice: what they and the empty one give to a one and to a zero, and what is left."""
    zeros, ones, longer = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16)
    at = nodes.column("key").to_numpy()
    zeros[at], ones[at], longer[at] = (nodes.column(c).to_numpy() for c in ("n", "ones", "longer"))
    zeros, ones, longer = (x.reshape(256, 256) for x in (zeros, ones, longer))
    p0, own0 = _estimate(zeros.sum(0)[None, :], ones.sum(0)[None, :])
    p1, own1 = _estimate(zeros, ones)
    w1, weighted1 = _weigh(own1, longer)
    w0, _ = _weigh(own0, weighted1.sum(0)[None, :])
    return w0 * p0 + (1 - w0) * w1 * p1, w0 * (1 - p0) + (1 - w0) * w1 * (1 - p1), (1 - w0) * (1 - w1)


def _logs(top, depth: int):
    """log10 of each gram's probability of its last byte after the others."""

    def run(batches):
        to_one, to_zero, left = top.value
        for b in batches:
            key = b.column(0).to_numpy()
            choices = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(-1, 8)
            last, byte, value = key >> (8 * depth), key & 255, np.zeros(len(key))
            for bit in range(8):
                node = (byte | 256) >> (8 - bit)
                given = np.where((byte >> (7 - bit)) & 1 == 1, to_one[last, node], to_zero[last, node])
                value += np.log10(given + left[last, node] * choices[:, bit])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(value)], names=["key", "n", "value"])

    return run


def gram_scores(counts: DataFrame, depth: int) -> DataFrame:
    """``key, n, value``: log10 of the probability of the last byte of every gram in ``counts`` (key, n)."""
    pair = F.shiftright("key", 8 * (depth - 1))
    tree = written(counts.select("key", "n").repartition(pair).sortWithinPartitions("key").mapInArrow(_grow(depth), _TREE), "tree")
    nodes = tree.where(F.col("kind") == _NODE).groupBy("key").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.sum("longer").alias("longer"))
    top = counts.sparkSession.sparkContext.broadcast(_top(nodes.toArrow()))  # a row for each byte and choice at most
    grams = tree.where(F.col("kind") == _GRAM).select("key", "n", "choices").mapInArrow(_logs(top, depth), "key long, n long, value double")
    out = written(grams, "grams")
    discard(tree)
    return out


_ROW = (
    "doc_id long, text_key long, kind byte, key long, n long, n_tokens long, head_known long, head_score double, score double"
)


def _pairs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
    return doc[new], key[new], np.diff(np.append(new, len(key)))


def _score(grams, head, depth: int):
    def run(batches):
        frequent, values = grams.value
        heads, logs = head.value
        for b in batches:
            keys = b.column(1).to_numpy(zero_copy_only=False)

            def tail(doc, kind, key, n):
                none = pa.nulls(len(doc), pa.int64())
                half = pa.nulls(len(doc), pa.float64())
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc)), pa.array(keys[doc]), pa.array(np.full(len(doc), kind, np.int8)), pa.array(key), pa.array(n), none, none, half, half],
                    names=_NAMES,
                )

            scores = np.zeros(len(b))
            for i, code, start, end in _coded(b.column(2), depth):
                met, of = np.unique(code, return_inverse=True)
                at = np.minimum(np.searchsorted(frequent, met), max(len(frequent) - 1, 0))
                known = frequent[at] == met if len(frequent) else np.zeros(len(met), bool)
                value = np.where(known, values[at], 0.0) if len(frequent) else np.zeros(len(met))
                sums = np.concatenate([[0.0], np.cumsum(value[of])])
                scores[i : i + len(start)] = sums[end] - sums[start]
                rare = ~known[of]
                if rare.any():
                    doc, key, n = _pairs(np.repeat(np.arange(i, i + len(start)), end - start)[rare], code[rare])
                    yield tail(doc, _GRAM, key, n)
            for w in words(b.column(2), NONBLANK):
                t = len(w.counts)
                at = np.minimum(np.searchsorted(heads, w.hash), max(len(heads) - 1, 0))
                known = heads[at] == w.hash if len(heads) else np.zeros(len(w.hash), bool)
                head_known = np.bincount(w.doc, weights=known, minlength=t)
                head_score = np.bincount(w.doc[known], weights=logs[at[known]], minlength=t)
                doc, key, n = _pairs(w.doc[~known].astype(np.int64) + w.first, w.hash[~known])
                yield tail(doc, _WORD, key.view(np.int64), n)
                here = slice(w.first, w.first + t)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(w.first, t), pa.array(keys[here]), pa.array(np.full(t, _TEXT, np.int8)), pa.array(keys[here]),
                        pa.array(np.zeros(t, np.int64)), pa.array(w.counts.astype(np.int64) + 1), pa.array(head_known.astype(np.int64)),
                        pa.array(head_score.astype(np.float64)), pa.array(scores[here]),
                    ],
                    names=_NAMES,
                )

    return run


_NAMES = ["doc_id", "text_key", "kind", "key", "n", "n_tokens", "head_known", "head_score", "score"]


def _least(table: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` rows of ``table`` reach with their ``n``."""
    sizes = table.where("n > 0").groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()
    least, total = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -r["e"]):
        if total + r["count"] > most:
            break
        least, total = 1 << r["e"], total + r["count"]
    return least


def score_texts(docs: DataFrame, training: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` picks the rows to learn from, by default those not ``held_out``; ``depth`` is the length of the longest
    contexts, 2 to 6 bytes.  Null and empty texts have one token, the end.  Repeated rows train as often as they come and get
    equal scores.  Without training rows every byte has probability 1/256 and no token is known.  Only doc_id and text
    are read.  An empty table gives no rows.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6 bytes")
    spark = docs.sparkSession
    learn = F.coalesce(~held_out() if training is None else training, F.lit(False))
    counted = docs.select("text", learn.alias("learn")).mapInArrow(_count(depth), "kind byte, key long, n long")
    counts = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    grams = gram_scores(counts.where(F.col("kind") == _GRAM), depth)
    least = _least(grams, GRAMS)
    top = grams.where(F.col("n") >= least).select("key", "value").toArrow()
    order = np.argsort(top.column(0).to_numpy())
    frequent = spark.sparkContext.broadcast((top.column(0).to_numpy()[order], top.column(1).to_numpy()[order]))
    rest_grams = grams.where(F.col("n") < least).select(F.lit(_GRAM).cast("byte").alias("kind"), "key", F.lit(None).cast("long").alias("c"), "value")
    vocabulary = counts.where((F.col("kind") == _WORD) & (F.col("n") > 0)).select("key", "n")
    facts = vocabulary.agg(F.count("*"), F.sum("n")).first()
    n_words, train_tokens = facts[0], facts[1] or 0
    least = _least(vocabulary, HEAD)
    top = vocabulary.where(F.col("n") >= least).toArrow()
    order = np.argsort(top.column(0).to_numpy().view(np.uint64))
    head = spark.sparkContext.broadcast(
        (top.column(0).to_numpy().view(np.uint64)[order], np.log10(top.column(1).to_numpy()[order] + 0.1))
    )
    rest = vocabulary.where(F.col("n") < least).select(
        F.lit(_WORD).cast("byte").alias("kind"), "key", F.col("n").alias("c"), F.lit(None).cast("double").alias("value"))
    end_count = vocabulary.where(F.col("key") == int(END_TOKEN.astype(np.int64))).select("n").first()
    end_count = end_count[0] if end_count else 0
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text").mapInArrow(_score(frequent, head, depth), _ROW)
    word, gram = F.col("kind") == _WORD, F.col("kind") == _GRAM
    met = rows.join(rest.unionByName(rest_grams), ["kind", "key"], "left").groupBy("doc_id", "text_key").agg(
        F.sum((F.col("kind") == _TEXT).cast("int")).alias("copies"), F.max("n_tokens").alias("n_tokens"), F.max("head_known").alias("head_known"),
        F.max("head_score").alias("head_score"), F.max("score").alias("score"),
        F.coalesce(F.sum(F.when(word & F.col("c").isNotNull(), F.col("n"))), F.lit(0)).alias("tail_known"),
        F.coalesce(F.sum(F.when(word, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1).cast("double")))), F.lit(0.0)).alias("tail_score"),
        F.coalesce(F.sum(F.when(gram, F.col("n") * F.col("value"))), F.lit(0.0)).alias("tail_grams"),
    )
    each = math.log10(train_tokens + 0.1 * (n_words + 1))
    return met.select(
        F.explode(F.expr("sequence(1, copies)")).alias("copy"), "doc_id", "text_key", held_out().alias("held_out"), "n_tokens",
        (F.col("head_known") + (F.col("tail_known") / F.col("copies")).cast("long") + (1 if end_count else 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.col("tail_score") / F.col("copies") + math.log10(end_count + 0.1) - F.col("n_tokens") * each).alias("base_score"),
        (F.col("score") + F.col("tail_grams") / F.col("copies")).alias("score"),
    ).drop("copy")
