r"""Line-first quality rules, in DataFrame operations only: one projection, no shuffle.

Every line is judged alone.  It fails if it

* is navigation: separators between every four words or fewer, or at most three words without a sentence end;
* is boilerplate: at most forty words with one of ``BOILERPLATE``;
* breaks punctuation: no sentence end in it or after it, doubled exclamation marks or symbols for every fourth word.

Failing lines go; a document that loses more than ``max_loss`` of its characters goes too.  Blank lines are not judged.

Repeated three-word windows are found without a shuffle: window hashes that carry their position in the low bits are
sorted, neighbours with equal hashes are looked up, and their words are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of boilerplate lines, in lower case.
BOILERPLATE = [
    "all rights reserved", "accept cookies", "click here", "cookie policy", "copyright (c)", "enable javascript", "follow us on",
    "licensed under", "log in to", "lorem ipsum", "newsletter", "powered by", "privacy policy", "read more", "released under the",
    "share this", "sign up", "subscribe to", "terms of service", "terms of use", "use of cookies", "under the gnu general public license",
]

SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›·•>]"
BLANKS = " \t\n\x0b\f\r"
SENTENCE_END = r"[.!?…:;。！？]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` reads it in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(ws: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""

    def windows(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long")))
        return _let(bits, lambda b: _let(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1, lambda low: found(w, b, low)))

    def found(w: Column, b: Column, low: Column) -> Column:
        packed = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")),
        )
        near = lambda x, y: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), b) == 0
        alike = _let(
            F.sort_array(packed),
            lambda s: F.filter(s, lambda x, i: ((i > 0) & near(x, F.get(s, i - 1))) | ((i < F.size(s) - 1) & near(x, F.get(s, i + 1)))),
        )
        said = F.transform(alike, lambda x: _let(x.bitwiseAND(low).cast("int"), lambda p: F.struct(F.concat_ws(" ", w[p], w[p + 1], w[p + 2]).alias("g"), p.alias("p"))))
        twice = _let(
            F.sort_array(said),
            lambda s: F.filter(s, lambda x, i: ((i > 0) & (x["g"] == F.get(s, i - 1)["g"])) | ((i < F.size(s) - 1) & (x["g"] == F.get(s, i + 1)["g"]))),
        )
        # each window adds three words, less those that the next one counts too
        return _let(
            F.sort_array(F.transform(twice, lambda x: x["p"])),
            lambda q: F.size(q) * 3
            - F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), F.lit(0), lambda a, i: a + F.when(i < F.size(q) - 1, F.greatest(F.lit(0), F.get(q, i) + 3 - F.get(q, i + 1))).otherwise(0)),
        )

    return F.when(F.size(ws) < 3, F.lit(0)).otherwise(F.coalesce(windows(ws), F.lit(0))).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line that is not blank goes."""
    plain = F.trim(line)
    n = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1
    ends = F.rlike(F.substring(plain, -4, 4), F.lit(SENTENCE_END))
    inside = F.rlike(plain, F.lit(SENTENCE_END + " "))
    said = F.lit("|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE))
    return (
        (F.regexp_count(plain, F.lit(SEPARATORS)) * 4 >= n)
        | ((n <= 3) & ~ends)
        | ((n <= 40) & F.rlike(F.lower(plain), said))
        | (~ends & ~inside)
        | (F.regexp_count(plain, F.lit("!!")) * 4 >= n)
        | (F.regexp_count(plain, F.lit(SYMBOLS)) * 4 >= n)
    )


def quality_rules(docs: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, kept.

    ``clean_text`` is the text without failing lines.  A null text counts as empty: no words, base_failed, not kept.
    Rows are judged alone, so repeated rows get equal results, and an empty table gives no rows.  Other columns pass
    through, whatever their names; a column named like a new one is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    ws = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    full = lambda x: F.btrim(x, F.lit(BLANKS)) != ""

    def judged(w: Column, lines: Column) -> Column:
        held = F.filter(lines, full)
        clean = F.filter(lines, lambda x: ~(full(x) & line_fails(x)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.size(held) - F.size(F.array_distinct(held))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"), F.array_join(clean, "\n").alias("clean_text"),
        )

    facts = _let(ws, lambda w: _let(F.split(text, "\n", -1), lambda lines: judged(w, lines)))
    new = ["n_words", "word_chars", "n_dup_lines", "n_repeat_words", "clean_text"]
    out = docs.withColumn("_judged", facts).withColumns({c: F.col("_judged")[c] for c in new}).drop("_judged")
    out = out.withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    lost = F.length(text) - F.length("clean_text")
    return out.withColumn("kept", ~F.col("base_failed") & (lost <= max_loss * F.length(text)))
