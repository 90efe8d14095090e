"""Faults of conversations and their cheapest repair.

Rows are dealt by ranges of (conversation, turn), so that a conversation of any length lies in order over as many tasks as
its rows need, and packed into slices of bounded size.  Each task compresses the slices' symbols with one grammar
(``repair_grammar``) and works out one min-plus matrix per slice.  A second pass reads only the matrices, in order, with a
vector of four states for each conversation, and says through which states the cheapest repair goes; with those, each
slice is edited alone.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushes.llm.common import written
from rushes.llm.repair_grammar import AFTER_ASSISTANT, AFTER_USER, EMPTY, MUST_GO, NOTHING, Rope, finish, matrices, symbol, times

#: Limits of a slice, and how many symbols share a grammar.
SLICE_ROWS, SLICE_CHARS, GRAMMAR_ROWS = 4096, 1 << 20, 1 << 16
_NONBLANK = r"[^\x20\x09-\x0D]"
_OPEN_END = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
#: Pairs of neighbouring role classes that are in order: su, ua, au.
_IN_ORDER = {(2, 0), (0, 1), (1, 0)}
_ORDER = ["turn", "role", "key", "again", "chunk"]


def _turns(rows: DataFrame) -> DataFrame:
    """Rows with their faults, equal ones counted: conv_id, turn, role, key, again, chunk, n, role_class, fault, text.

    ``fault`` is 0, or 1 for blank, 2 for duplicate, 3 for truncated; rows that must go have no text.  Equal rows are
    combined before they are shuffled, and each text is shuffled once.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    key = F.md5(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")))
    blank = ~F.col("text").rlike(_NONBLANK)
    rows = rows.withColumns({"key": key, "is_blank": blank})
    first = rows.groupBy("conv_id", "key").agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("no_turn"), F.first("role").alias("role"), F.first("text").alias("text"),
        F.first("is_blank").alias("is_blank"),
    )
    first = written(first, "texts")
    at_first = F.when(F.col("no_turn"), F.lit(None)).otherwise(F.col("least"))
    fault = F.when(F.col("is_blank"), 1).when(F.col("text").rlike(_OPEN_END), 3).otherwise(0)
    kept = first.select(
        "conv_id", at_first.alias("turn"), "role", "key", F.lit(False).alias("again"), F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("n"),
        fault.alias("fault"), F.when(~F.col("is_blank"), F.col("text")).alias("text"),
    )
    counts = rows.groupBy("conv_id", "turn", "key").agg(F.count("*").alias("n"), F.first("role").alias("role"), F.first("is_blank").alias("is_blank"))
    where = first.select(F.col("conv_id").alias("_c"), F.col("key").alias("_k"), at_first.alias("_t"))
    more = counts.join(where, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")))
    more = more.withColumn("n", F.col("n") - F.col("turn").eqNullSafe(F.col("_t")).cast("long")).where("n > 0")
    more = more.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {SLICE_ROWS})"))).select(
        "conv_id", "turn", "role", "key", F.lit(True).alias("again"), "chunk", F.least(F.lit(SLICE_ROWS), F.col("n") - F.col("chunk") * SLICE_ROWS).alias("n"),
        F.when(F.col("is_blank"), 1).otherwise(2).alias("fault"), F.lit(None).cast("string").alias("text"),
    )
    classes = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in zip("uas", range(3)) for x in p]), F.substring("role", 1, 1)), F.lit(3))
    return written(kept.unionByName(more).withColumn("role_class", classes), "turns")


class _Slice:
    def __init__(self, conv, at):
        self.conv, self.at = conv, at
        self.codes, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.counts, self.illegal, self.first, self.last = [0, 0, 0, 0], 0, None, None

    def add(self, role_class, n, fault, role, text):
        code = MUST_GO if fault in (1, 2) else symbol(role_class, fault == 3)
        self.codes += bytes([code]) * n
        self.counts[fault] += n
        if self.last is not None:
            self.illegal += (self.last, role_class) not in _IN_ORDER
        self.illegal += n - 1  # a role next to itself is never in order
        self.first = role_class if self.first is None else self.first
        self.last = role_class
        if code != MUST_GO:
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)


def _packed(slices: list[_Slice], schema: pa.Schema) -> pa.RecordBatch:
    of = matrices([bytes(s.codes) for s in slices])
    shown = {k: ([x and x[0] for x in m], [x and str(x[1]) for x in m]) for k, m in of.items()}
    cols = [[s.conv for s in slices], *([s.at[i] for s in slices] for i in range(len(_ORDER)))]
    cols += [[len(s.codes) for s in slices], *([s.counts[i] for s in slices] for i in (1, 2, 3)), [s.illegal for s in slices]]
    cols += [[s.first for s in slices], [s.last for s in slices], *([shown[bytes(s.codes)][i] for s in slices] for i in (0, 1))]
    cols += [[bytes(s.codes) for s in slices], [s.roles for s in slices], [s.texts for s in slices]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_SLICE = (
    "turn long, role string, key string, again boolean, chunk long, n_rows long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, "
    "first int, last int, cost array<long>, audit array<string>, codes binary, roles array<string>, texts array<string>"
)
_CHOICE = "turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _schema(rows: DataFrame, rest: str):
    """The Spark schema of conv_id and ``rest``, and the Arrow schema that goes with it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark_schema = StructType([*rows.select("conv_id").schema.fields, *StructType.fromDDL(rest).fields])
    return spark_schema, to_arrow_schema(spark_schema)


def _slices(rows: DataFrame) -> DataFrame:
    spark_schema, schema = _schema(rows, _SLICE)

    def run(batches):
        ready, size, now = [], 0, None
        for b in batches:
            for conv, turn, role, key, again, chunk, n, fault, text, role_class in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now.conv != conv or len(now.codes) + n > SLICE_ROWS or now.chars > SLICE_CHARS:
                    if now is not None:
                        ready.append(now)
                        size += len(now.codes)
                    if size >= GRAMMAR_ROWS or sum(s.chars for s in ready[-64:]) > 16 * SLICE_CHARS:
                        yield _packed(ready, schema)
                        ready, size = [], 0
                    now = _Slice(conv, (turn, role, key, again, chunk))
                now.add(role_class, n, fault, role, text)
        if now is not None:
            yield _packed([*ready, now], schema)

    turns = _turns(rows)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartitionByRange(n, "conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    columns = ["conv_id", *_ORDER, "n", "fault", "text", "role_class"]
    return written(written(dealt.select(*columns).mapInArrow(run, spark_schema), "packed").withColumn("slice", F.monotonically_increasing_id()), "slices")


def _chosen(slices: DataFrame) -> DataFrame:
    """For every slice: slice, enter, leave (states), tail (insertions after the last), and on the last one the conversation's figures."""
    spark_schema, schema = _schema(slices, f"slice long, enter int, leave int, tail string, parts long, {_CHOICE}")

    def settled(conv, path, sums, vector):
        cost, state, edits, tail = finish(vector)
        out, rest = [], [len(path), *sums, cost, str(edits)]
        for slice_id, back in reversed(path):
            out.append([conv, slice_id, back[state], state, tail, len(path), *(rest[1:] if not out else [None] * 7)])
            state, tail = back[state], ""
        return out

    def run(batches):
        now, out = None, []
        for b in batches:
            for conv, slice_id, n, n_blank, n_dup, n_trunc, n_illegal, first, last, cost, audit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out += settled(*now[:4])
                    now = [conv, [], [0] * 5, [(0, EMPTY), None, None, None], None]
                vector = now[3]
                moves = [None if c is None else (c, Rope(a)) for c, a in zip(cost, audit, strict=True)]
                back = []
                for j in range(4):  # one state before at a time tells where the product came from
                    ways = []
                    for i in range(4):
                        if vector[i] is not None and moves[4 * i + j] is not None:
                            ways.append((vector[i][0] + moves[4 * i + j][0], vector[i][1] + moves[4 * i + j][1], i))
                    back.append(min(ways, key=_Least)[2] if ways else None)
                now[3] = times(vector, moves, 1)
                now[1].append((slice_id, back))
                for i, x in enumerate((n, n_blank, n_dup, n_trunc, n_illegal + (now[4] is not None and (now[4], first) not in _IN_ORDER))):
                    now[2][i] += x
                now[4] = last
                if len(out) >= 5000:
                    yield _rows(out, schema)
                    out = []
        if now is not None:
            out += settled(*now[:4])
        if out:
            yield _rows(out, schema)

    columns = ["conv_id", "slice", "n_rows", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "first", "last", "cost", "audit"]
    ordered = slices.select(*columns, *_ORDER[:1], *(c for c in _ORDER[1:])).repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    return written(ordered.select(*columns).mapInArrow(run, spark_schema), "choices")


class _Least:
    """Orders (cost, edits, state) by cost, then by edits."""

    def __init__(self, way):
        self.way = way

    def __lt__(self, other):
        a, b = self.way, other.way
        return a[0] < b[0] or a[0] == b[0] and a[1] < b[1]


def _rows(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _edited(slices: DataFrame, choices: DataFrame) -> DataFrame:
    """conv_id, the order columns, parts, and ``turns``: the repaired rows of each slice with their edits, I, K or R."""
    spark_schema, schema = _schema(slices, "turn long, role string, key string, again boolean, chunk long, parts long, turns array<struct<edit:string,role:string,text:string>>")

    def run(batches):
        for b in batches:
            made = []
            for codes, roles, texts, enter, edits in zip(*(b.column(i).to_pylist() for i in range(7, 12)), strict=True):
                state, at, row, out = enter, 0, 0, []
                for e in edits:
                    there = e != "I" and codes[row] != MUST_GO
                    if e != "D":
                        role = roles[at] if e == "K" else "user" if state in AFTER_USER else "assistant"
                        out.append({"edit": e, "role": role, "text": "" if e == "I" else texts[at]})
                        system = e == "K" and state == NOTHING and role[:1] == "s"
                        state = 1 if system else (AFTER_USER | AFTER_ASSISTANT)[state]
                    at += there
                    row += e != "I"
                made.append(out)
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(made, schema.field("turns").type)], schema=schema)

    edits = F.concat(F.get("audit", F.col("enter") * 4 + F.col("leave")), F.col("tail")).alias("edits")
    joined = slices.join(choices.select("slice", "enter", "leave", "tail", "parts"), "slice")
    return joined.select("conv_id", *_ORDER, "parts", "codes", "roles", "texts", "enter", edits).mapInArrow(run, spark_schema)


def _digests(edited: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256.  Conversations of several slices stream through one hash each, slice by slice."""
    body = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    lines = edited.withColumns({"body": body, "filled": F.size("turns") > 0})
    spark_schema, schema = _schema(edited, "repaired_sha256 string")

    def run(batches):
        now, done = None, []
        for b in batches:
            for conv, text, filled in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append([now[0], now[1].hexdigest()])
                    now = [conv, hashlib.sha256(), False]
                if filled:
                    now[1].update(("\n" if now[2] else "").encode() + text.encode())
                    now[2] = True
            if done:
                yield _rows(done, schema)
                done = []
        if now is not None:
            yield _rows([[now[0], now[1].hexdigest()]], schema)

    one = lines.where("parts = 1").select("conv_id", F.sha2("body", 256).alias("repaired_sha256"))
    several = lines.where("parts > 1").repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    return one.unionByName(several.select("conv_id", "body", "filled").mapInArrow(run, spark_schema))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, turn and chunk of the slice that they come from, position in it, edit (I, K or R), role, text.

    Ordered by conv_id, turn, slice_role, slice_key, slice_again, chunk and position they are the repaired conversations.
    """
    slices = _slices(rows)
    edited = _edited(slices, _chosen(slices))
    renamed = edited.withColumnsRenamed({"role": "slice_role", "key": "slice_key", "again": "slice_again"})
    return renamed.select("conv_id", "turn", "slice_role", "slice_key", "slice_again", "chunk", F.posexplode("turns").alias("position", "_row")).select("*", "_row.*").drop("_row")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, turns, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation of ``rows``.

    Rows of a conversation are taken by turn, those without one first, and within a turn by role and by the hash of role and
    text.  A row's first fault counts: blank (nothing but white space), duplicate (role and text stood earlier), truncated
    (the last character that isn't white space is none of ``.!?``).  ``illegal`` counts neighbours whose role initials
    aren't su, ua or au; ``gaps`` are the turn numbers that lack between the least and the largest.

    Edits keep a row (0), make it a user or assistant row (1), delete it (2; blank and duplicate rows must go) or insert an
    empty one (5); each truncated row that stays adds 5.  ``audit`` has the initials of the cheapest edits, of equally cheap
    ones the ASCII-least, after which the role initials are ``(s?(ua)+)?``.  ``repaired_sha256`` is that of the repaired
    rows as ``role:text`` lines.

    A null role or text is one space; an empty role counts as one that is none of the three.  A null conv_id is a
    conversation of its own.  Equal rows are duplicates of the first.  Only the four columns are read, an empty table gives
    no rows.
    """
    slices = _slices(rows)
    choices = _chosen(slices)
    distinct = rows.groupBy("conv_id").agg(F.max("turn").alias("_max"), F.min("turn").alias("_min"), F.count_distinct("turn").alias("_n"))
    gaps = distinct.select(F.col("conv_id").alias("_c"), F.coalesce(F.col("_max") - F.col("_min") + 1 - F.col("_n"), F.lit(0)).cast("long").alias("gaps"))
    hashes = _digests(_edited(slices, choices)).withColumnRenamed("conv_id", "_d")
    last = choices.where("audit IS NOT NULL").select("conv_id", *(x.split()[0] for x in _CHOICE.split(", ")))
    joined = last.join(gaps, F.col("conv_id").eqNullSafe(F.col("_c"))).join(hashes, F.col("conv_id").eqNullSafe(F.col("_d")))
    return joined.select("conv_id", "turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
