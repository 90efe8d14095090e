"""Token ids in files of directly addressable codes.

An id is cut into 8-bit chunks, the lowest first.  Level 0 holds the lowest chunk of every id; its bitmap says which ids
go on, and level 1 holds the next chunk of those alone, in the same order, and so on.  The rank directory of a bitmap
counts the set bits before each block of 512.  The chunk of token i at the next level stands at the rank of bit i, so any
token is read with one look at each level, without decoding what stands before it.

A file holds segments, rows of about ``SEGMENT`` tokens: chunks, bitmaps, ranks, and the documents in them with their
places.  Files ascend by doc_id.  They are Parquet, so that they live in whatever store Spark reads and writes.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rushes.llm.common import text_key
from rushes.llm.words import LOWER, text_bytes
from rushes.session import checkpoint_dir

SEGMENT = 1 << 17
#: Bytes of text that are encoded together, so that each distinct word of them is looked up once.
TOGETHER = 3 << 20
BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)

SCHEMA = (
    "part int, first long, n_tokens long, doc_ids array<long>, text_keys array<long>, starts array<long>, "
    "chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
)


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, bitmaps and rank directories of each level."""
    chunks, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), BLOCK // 8)) if len(bits) else np.zeros(0, np.int64)
        chunks.append((rest & 255).astype(np.uint8).tobytes())
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4").tobytes() if len(bits) else b"")
        if not more.any():
            return chunks, bitmaps, ranks
        rest = rest[more] >> np.uint32(8)


def access(segment: tuple[list[bytes], list[bytes], list[bytes]], at: np.ndarray) -> np.ndarray:
    """The ids at the positions ``at``, each found through the rank directories."""
    out = np.zeros(len(at), np.uint32)
    who, pos = np.arange(len(at)), np.asarray(at, np.int64)
    for level, (c, b, r) in enumerate(zip(*segment)):
        chunk, bits, rank = np.frombuffer(c, np.uint8), np.frombuffer(b, np.uint8), np.frombuffer(r, "<u4")
        out[who] |= chunk[pos].astype(np.uint32) << np.uint32(8 * level)
        byte, bit = pos >> 3, (pos & 7).astype(np.uint8)
        more = (bits[byte] >> bit) & 1 == 1
        if not more.any():
            break
        pos, byte, bit, who = pos[more], byte[more], bit[more], who[more]
        block = pos // BLOCK
        before = rank[block].astype(np.int64)
        inside = byte - block * (BLOCK // 8)
        for j in range(BLOCK // 8 - 1):  # whole bytes of the block before the bit
            some = inside > j
            if not some.any():
                break
            before[some] += _ONES[bits[block[some] * (BLOCK // 8) + j]]
        before += _ONES[bits[byte] & ((np.uint16(1) << bit) - 1).astype(np.uint8)]
        pos = before
    return out


def unpack(segment: tuple[list[bytes], list[bytes], list[bytes]]) -> np.ndarray:
    """All ids of a segment, level by level from the last."""
    levels = [(np.frombuffer(c, np.uint8), np.unpackbits(np.frombuffer(b, np.uint8), count=len(c), bitorder="little").astype(bool)) for c, b in zip(*segment[:2])]
    high = np.zeros(0, np.uint32)
    for chunk, more in reversed(levels):
        ids = chunk.astype(np.uint32)
        if len(high):
            ids[more] |= high << np.uint32(8)
        high = ids
    return high


_SPECIAL = "<|"


class WordEncoder:
    """Whole texts encoded word by word, for a tokenizer that lower-cases, drops white space and ends each word alone.

    Words between spaces don't depend on each other, so each distinct one is encoded once and kept, in two generations of
    ``limit`` words each; a word that is met again moves to the newer one.
    New words of letters go to the tokenizer many at a time; the ids that end a word tell them apart again.  Whether the
    tokenizer is of that kind is tried on loading; texts of any other are handed to it whole.
    """

    def __init__(self, path: str, limit: int = 320_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known, self.older = Tokenizer.from_file(path), limit, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.by_words = self._works_by_words()

    def _works_by_words(self) -> bool:
        """Whether words on their own give what they give in texts, on texts that would tell."""
        tried = ["Some WORDS, and more.", "a b\nc  d", "it's can't 12 3.5 x_y", "Ünïcode É ß ﬁ", "end. next! \"quoted\" (so)", "tab\tand\r\nline", "word", " word"]
        try:
            return self.ends.any() and all(self._by_words(pa.array([t]))[0].tolist() == self._one(t).tolist() for t in tried)
        except ValueError:
            return False

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, new: list[str]) -> None:
        letters, others = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        for i in range(0, len(others), 2000):
            made = self.tokenizer.encode_batch_fast(others[i : i + 2000], add_special_tokens=False)
            self.known.update((w, np.array(x.ids, np.int32).tobytes()) for w, x in zip(others[i : i + 2000], made))
        parts = [letters[i : i + 2000] for i in range(0, len(letters), 2000)]
        for part in parts:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # a letter that lower-cases to something else
                self.known.update((w, self._one(w).tobytes()) for w in part)
                continue
            data, at = ids.tobytes(), [0, *(4 * stops).tolist()]
            self.known.update(zip(part, (data[x:y] for x, y in zip(at, at[1:]))))

    def _by_words(self, column: pa.Array) -> list[np.ndarray]:
        data, offsets = text_bytes(column)
        data, offsets = LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            apart = _APART[data]
            cut[1:-1] = apart[1:] & ~apart[:-1]
            stop = np.append(apart[1:], True) & _STOP[data]
            stop[offsets[1:][offsets[1:] > 0] - 1] |= _STOP[data[offsets[1:][offsets[1:] > 0] - 1]]
            at = np.flatnonzero(stop)
            at = at[at > 0]
            cut[at[_LETTER[data[at - 1]]]] = True
        cut[offsets] = True
        at = np.flatnonzero(cut)
        words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        self.known.setdefault("", b"")
        names = [w.lstrip(" \n") for w in distinct]
        new = [w for w in dict.fromkeys(names) if w not in self.known]
        self.known.update((w, self.older[w]) for w in new if w in self.older)
        self._learn([w for w in new if w not in self.older])
        spelt = [self.known[w] for w in names]
        sizes = np.array([len(x) for x in spelt], np.int64) >> 2
        ids, code = np.frombuffer(b"".join(spelt), np.int32), words.indices.to_numpy().astype(np.int64)
        n = sizes[code]
        total = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[code] - total[:-1], n) + np.arange(total[-1])]
        return np.split(out, total[np.searchsorted(at, offsets[1:-1])]) if len(offsets) > 1 else []

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of every text; null counts as empty."""
        column = pc.fill_null(column, "")
        # Names of special tokens depend on case and may stand anywhere.
        whole = pc.match_substring(column, _SPECIAL).to_numpy(zero_copy_only=False) | (not self.by_words)
        out = self._by_words(pc.if_else(pa.array(whole), "", column) if whole.any() else column) if self.by_words else [None] * len(column)
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._one(column[i].as_py())
        return out


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


#: What stands between words; what a word may lose at its end; letters before which it does.
_APART, _STOP, _LETTER = _table(" \n"), _table(".,;:!?"), _table("abcdefghijklmnopqrstuvwxyz")
_encoders: dict[str, WordEncoder] = {}


def _encoded(texts: pa.Array, path: str) -> list[np.ndarray]:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path].encode(texts)


def _write(path: str, end: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        docs, keys, ids, held, first = [], [], [], 0, 0

        def segment():
            nonlocal docs, keys, ids, held, first
            sizes = [len(x) for x in ids]
            c, b, r = pack(np.concatenate(ids))
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                    pa.array([keys], pa.list_(pa.int64())), pa.array([[0, *np.cumsum(sizes)[:-1].tolist()]], pa.list_(pa.int64())),
                    *(pa.array([x], pa.list_(pa.binary())) for x in (c, b, r)),
                ],
                names=["part", "first", "n_tokens", "doc_ids", "text_keys", "starts", "chunks", "bitmaps", "ranks"],
            )
            first += held
            docs, keys, ids, held = [], [], [], 0
            return row

        for whole in batches:
            bytes_ = np.cumsum(pc.fill_null(pc.binary_length(whole.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
            for i in np.flatnonzero(np.diff(bytes_, prepend=-1)).tolist():
                b = whole.slice(i, int(np.searchsorted(bytes_, bytes_[i], "right")) - i)
                for d, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _encoded(b.column(2), path)):
                    docs.append(d)
                    keys.append(k)
                    ids.append(np.append(x, np.int32(end)))
                    held += len(x) + 1
                    if held >= SEGMENT:
                        yield segment()
        if docs:
            yield segment()

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end: int = 1) -> None:
    """Encode every text, end it with the id ``end``, and write the files in ascending order of doc_id.

    Null doc_ids come first, and texts of one doc_id are ordered by their hash.  A null text counts as empty: its one id
    is the end.  Repeated rows are written as often as they come.  Only doc_id and text are read.  A document is never
    split over segments.  Without documents there are files without segments.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    ordered = keyed.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    ordered.mapInArrow(_write(tokenizer, end), SCHEMA).write.parquet(out)


def _documents(offsets: dict[int, int]):
    def run(batches):
        for b in batches:
            for i in range(len(b)):
                row = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                ids = unpack((row["chunks"], row["bitmaps"], row["ranks"])).astype("<u4")
                starts = row["starts"]
                ends = [*starts[1:], row["n_tokens"]]
                base = offsets[row["part"]] + row["first"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(row["text_keys"], pa.int64()), pa.array([base + s for s in starts], pa.int64()),
                        pa.array([e - s for s, e in zip(starts, ends)], pa.int64()),
                        pa.array([zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends)], pa.int64()),
                    ],
                    names=["doc_id", "text_key", "start", "n_tokens", "ids_crc32"],
                )

    return run


def _offsets(spark: SparkSession, path: str) -> dict[int, int]:
    """The ids before each part: one number for each file, whatever the number of tokens."""
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    out, total = {}, 0
    for r in sorted(parts, key=lambda r: r["part"]):
        out[r["part"]], total = total, total + r["n"]
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text_key, start, n_tokens, ids_crc32) of every document, from the files alone."""
    return spark.read.parquet(path).mapInArrow(_documents(_offsets(spark, path)), "doc_id long, text_key long, start long, n_tokens long, ids_crc32 long")


def read_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, id): the ids at ``positions`` (position, counted over all documents), by direct access.

    Positions outside the files, and null ones, give no row; repeated positions give one.
    """
    offsets = _offsets(spark, path)
    part_start = F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), F.lit(o))]) if offsets else F.create_map().cast("map<int,bigint>")
    segments = spark.read.parquet(path).select(
        (part_start[F.col("part")] + F.col("first")).alias("lo"), "n_tokens", "chunks", "bitmaps", "ranks"
    )
    step = SEGMENT
    cells = F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("lo") + F.col("n_tokens") - 1) / step))).alias("cell")
    asked = positions.select(F.col("position").cast("long")).distinct().withColumn("cell", F.floor(F.col("position") / step))
    hits = asked.join(segments.select("*", cells).select("lo", "n_tokens", "cell"), "cell").where("position >= lo and position < lo + n_tokens")
    wanted = hits.groupBy("lo").agg(F.collect_set(F.col("position") - F.col("lo")).alias("at"))  # at most a segment's tokens

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                lo, at, c, m, r = (b.column(j)[i].as_py() for j in range(5))
                at = np.array(at, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at + lo), pa.array(access((c, m, r), at).astype(np.int64))], names=["position", "id"])

    return segments.join(wanted, "lo").select("lo", "at", "chunks", "bitmaps", "ranks").mapInArrow(run, "position long, id long")


def token_documents(docs: DataFrame, tokenizer: str | None = None, end: int = 1, out: str | None = None) -> DataFrame:
    """Write the files and read every document's place, length and checksum back from them.

    Rows: doc_id, text_key, start, n_tokens, ids_crc32, one for each row of ``docs``, repeated ones included.  A null or empty
    text has one id, the end; null doc_ids come first.  Only doc_id and text are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    out = out or f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, out, tokenizer, end)
    return read_documents(spark, out)
