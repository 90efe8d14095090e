"""Quality classifier from weak labels.

Ten overlapping heuristics vote good, bad or nothing on every document.  Their votes are counted by pattern over all
documents, a table of at most 3^10 rows, on which expectation-maximisation estimates how often each heuristic says
"bad" of good and of bad documents, and the share of good ones.  A heuristic is
taken to be wrong on ``FALSE_ALARM`` of the good documents at most, which tells the two classes apart.  The posterior of a document's pattern labels a sample
of at most about ``sample`` documents, chosen by hash, from which a logistic scorer learns weights of hashed features:
three-grams of byte classes, words, and buckets of the measures behind the votes.  The scorer then judges every
document by its whole text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rushes.llm.common import text_key
from rushes.llm.words import NONBLANK, Words, grams, words

SAMPLE = 8000
FALSE_ALARM = 0.005
WORD_BITS = 14
BUCKETS = 16

_CLASS = np.full(256, 4, np.uint8)  # other control and ASCII punctuation
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 3
for _code, _chars in ((5, " \t"), (6, "\n\r"), (7, "."), (8, ",;:"), (9, "!"), (10, "?"), (11, "|"), (12, "#*$%&"), (13, "<>{}[]()"), (14, "'\"-"), (15, "@/\\=_+~^`")):
    for _c in _chars:
        _CLASS[ord(_c)] = _code

MEASURES = ["symbols", "separators", "capitals", "shouts", "sentence", "repeats", "novelty", "word_size", "letters", "length"]
SLOTS = 16**3 + (1 << WORD_BITS) + len(MEASURES) * BUCKETS


def measures(w: Words) -> np.ndarray:
    """(texts, 10): what the heuristics look at, each a ratio except the number of words."""
    classes = _CLASS[w.data]

    def count(flags):
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[w.bounds])

    n, size = np.maximum(w.counts, 1), np.maximum(np.diff(w.bounds), 1)
    upper = count(classes == 1)
    letters = np.maximum(upper + count((classes == 0) | (classes == 3)), 1)
    shout = classes == 9
    shouts = count(shout & np.concatenate([shout[1:], [False]])) if len(shout) else np.zeros(len(n), np.int64)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    g, ok = grams(w, 3)
    i = np.flatnonzero(ok)
    order = np.lexsort((g[i], w.doc[i]))
    g, d = g[i][order], w.doc[i][order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.zeros(0, bool)
    of = lambda docs, flags: np.bincount(docs, weights=flags, minlength=len(n))
    ends = count((classes == 7) | (classes == 9) | (classes == 10))
    return np.stack(
        [
            count(classes == 12) / size, count(classes == 11) / n, upper / letters, shouts / n, n / np.maximum(ends, 1) / 100,
            of(w.doc, same) / n, np.where(w.counts > 2, of(d, new) / np.maximum(w.counts - 2, 1), 1.0), size / n / 20, letters / size, w.counts.astype(float),
        ],
        axis=1,
    )


def votes(m: np.ndarray) -> np.ndarray:
    """(texts, 10): 2 good, 1 bad, 0 no vote.  A text without words gets only bad votes from ``length``."""

    def rule(x, bad, good):
        return np.where(bad(x), 1, np.where(good(x), 2, 0))

    v = np.stack(
        [
            rule(m[:, 0], lambda x: x > 0.05, lambda x: x < 0.01), rule(m[:, 1], lambda x: x > 0.2, lambda x: x < 0.05),
            rule(m[:, 2], lambda x: x > 0.5, lambda x: x < 0.2), rule(m[:, 3], lambda x: x > 0.2, lambda x: x < 0.02),
            np.where(m[:, 9] < 20, 0, rule(m[:, 4], lambda x: (x > 1.0) | (x < 0.02), lambda x: (x < 0.5) & (x > 0.03))), rule(m[:, 5], lambda x: x > 0.3, lambda x: x < 0.05),
            rule(m[:, 6], lambda x: x < 0.6, lambda x: x > 0.9), rule(m[:, 7], lambda x: (x > 1.0) | (x < 0.1), lambda x: (x > 0.15) & (x < 0.6)),
            rule(m[:, 8], lambda x: x < np.where(m[:, 9] < 20, 0.6, 0.745), lambda x: x > 0.78), rule(m[:, 9], lambda x: x == 0, lambda x: x >= 20),
        ],
        axis=1,
    )
    v[m[:, 9] == 0, :-1] = 0
    return v


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def posteriors(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """P(good) of every vote pattern, by expectation-maximisation on the counts of patterns.

    Starts from "bad if any heuristic says so"; every rate has a pseudo-count, so no vote is ever certain.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes], float)
    v = (codes[:, None] // 3 ** np.arange(len(MEASURES))) % 3
    p = np.where((v == 1).any(1), 0.1, 0.95)
    for _ in range(rounds):
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        logs = np.stack([np.full(len(n), math.log(1 - prior)), np.full(len(n), math.log(prior))])
        for k, q in ((0, 1 - p), (1, p)):
            voted = ((v > 0) * (n * q)[:, None]).sum(0)
            bad = (((v == 1) * (n * q)[:, None]).sum(0) + (0.2 if k == 0 else 0.01)) / (voted + (1.0 if k == 0 else 1.0))
            bad = np.clip(bad, 1e-4, FALSE_ALARM if k else 1 - 1e-4)
            logs[k] += np.where(v == 1, np.log(bad), np.where(v == 2, np.log(1 - bad), 0.0)).sum(1)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return dict(zip(codes.tolist(), p.tolist()))


def _stat_slots(m: np.ndarray) -> np.ndarray:
    scaled = np.clip(m * BUCKETS, 0, BUCKETS - 1).astype(np.int64)
    scaled[:, -1] = np.clip(np.log2(m[:, -1] + 1), 0, BUCKETS - 1).astype(np.int64)
    return 16**3 + (1 << WORD_BITS) + np.arange(len(MEASURES)) * BUCKETS + scaled


def _class_grams(w: Words):
    """Slots of the byte-class three-grams from each byte on; the last two of a text run into the next, zeros at the end."""
    c = np.concatenate([_CLASS[w.data], np.zeros(2, np.uint8)]).astype(np.int64)
    return c[:-2] * 256 + c[1:-1] * 16 + c[2:]


def _word_slots(w: Words) -> np.ndarray:
    return 16**3 + (w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def scores(w: Words, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """P(good) of every text."""
    by_byte = np.concatenate([[0.0], np.cumsum(weights[_class_grams(w)])])[w.bounds]
    z = 10 * np.diff(by_byte) / np.maximum(np.diff(w.bounds), 1)
    z += 10 * np.bincount(w.doc, weights=weights[_word_slots(w)], minlength=len(w.counts)) / np.maximum(w.counts, 1)
    z += weights[_stat_slots(m)].sum(1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _patterns(batches):
    counts: dict[int, int] = {}
    for b in batches:
        for w in words(b.column(0), NONBLANK, lower=False):
            for c, n in zip(*np.unique(pattern(votes(measures(w))), return_counts=True)):
                counts[int(c)] = counts.get(int(c), 0) + int(n)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])


def _examples(good):
    """Features and posterior of sampled texts: what training needs and no more."""

    def run(batches):
        for b in batches:
            for w in words(b.column(0), NONBLANK, lower=False):
                m = measures(w)
                p = [good.value.get(int(c), 0.5) for c in pattern(votes(m))]
                byte, word, stat = _class_grams(w), _word_slots(w), _stat_slots(m)
                ends, rows = np.cumsum(w.counts), []
                for d in range(len(w.counts)):
                    i1, n1 = np.unique(byte[w.bounds[d] : w.bounds[d + 1]], return_counts=True)
                    i2, n2 = np.unique(word[ends[d] - w.counts[d] : ends[d]], return_counts=True)
                    x = np.concatenate([10 * n1 / max(n1.sum(), 1), 10 * n2 / max(n2.sum(), 1), np.ones(len(MEASURES) + 1)])
                    rows.append((np.concatenate([i1, i2, stat[d], [SLOTS]]).astype(np.int32), x.astype(np.float32), p[d]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.float64())],
                    names=["slots", "x", "p"],
                )

    return run


def _train(epochs: int):
    """Logistic regression with adaptive steps on the bounded sample, in one task; rows come in one fixed order."""

    def run(batches):
        rows = [(s, x, p) for b in batches for s, x, p in zip(*(c.to_numpy(zero_copy_only=False) for c in b.columns))]
        weights, seen, rng = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-2), np.random.default_rng(5)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                s, x, p = rows[i]
                z = min(max(float(weights[s] @ x), -50.0), 50.0)
                g = (1 / (1 + math.exp(-z)) - p) * x + 1e-4 * weights[s]
                seen[s] += g * g
                weights[s] -= 0.3 * g / np.sqrt(seen[s])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64())), pa.array([len(rows)], pa.int64())], names=["weights", "n"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, epochs: int = 5) -> tuple[dict[int, float], np.ndarray]:
    """(posterior of every vote pattern, weights of the scorer)."""
    spark = docs.sparkSession
    rows = docs.select("text").mapInArrow(_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts = {r["pattern"]: r["n"] for r in rows}
    good = posteriors(counts)
    known = spark.sparkContext.broadcast(good)
    share = min(1.0, sample / max(sum(counts.values()), 1))
    key = F.xxhash64(F.col("doc_id").cast("long"), text_key())
    # Millionths of the hashes, and of the next millionth its share by another hash, so that any share is kept.
    whole, part, slot = int(share * 1e6), share * 1e6 % 1, F.pmod(key, F.lit(1_000_000))
    within = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 40)) < int(part * (1 << 40))
    chosen = docs.where((slot < whole) | ((slot == whole) & within)).select("text")
    few = chosen.mapInArrow(_examples(known), "slots array<int>, x array<float>, p double")
    found = few.repartition(1).sortWithinPartitions("p", F.xxhash64("slots", "x")).mapInArrow(_train(epochs), "weights array<double>, n long").first()
    if counts and not (found and found["n"]):
        raise RuntimeError("no document fell into the training sample; ask for a larger one")
    return good, np.array(found["weights"]) if found else np.zeros(SLOTS + 1)


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``vote_posterior``, ``score`` (both P(good)) and ``kept`` (score of ``threshold`` or more).

    Null and empty texts get the posterior of their one bad vote and are scored like any other.  Texts are judged alone,
    so repeated rows get equal results.  All columns of ``docs`` pass through; they must not have the three new names.
    An empty table gives no rows.  A sample into which no document falls is an error.
    """
    good, weights = fit(docs, sample)
    sc = docs.sparkSession.sparkContext
    known, learned = sc.broadcast(good), sc.broadcast(weights)
    at, names = docs.columns.index("text"), [*docs.columns, "vote_posterior", "score", "kept"]

    def run(batches):
        for b in batches:
            p, s = [], []
            for w in words(b.column(at), NONBLANK, lower=False):
                m = measures(w)
                p += [known.value.get(int(c), 0.5) for c in pattern(votes(m))]
                s.append(scores(w, m, learned.value))
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64()), pa.array(s), pa.array(s >= threshold)], names=names)

    new = StructType().add("vote_posterior", "double").add("score", "double").add("kept", "boolean")
    return docs.mapInArrow(run, StructType(docs.schema.fields + new.fields))


def drop_low_quality(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """``docs`` without what the classifier rejects; all columns stay as they are, but may not be those that ``classify`` adds.

    Null and empty texts are judged like any other, repeated rows alike; an empty table stays empty.
    """
    return classify(docs, sample, threshold).where("kept").select(*docs.columns)
