"""SentencePiece encoding and decoding of document tables by shortest paths through compiled transducers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from rushes.llm.pieces import Model

_models: dict[str, Model] = {}


#: Bytes of text that are encoded together, so that each distinct word of them is composed once.
TOGETHER = 2 << 20


def compiled(path: str) -> Model:
    """The machines of a model file, compiled once in each Python process."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens``, ``n_bytes`` (ids of byte fallback) and ``exact`` in place of ``text``.

    ``exact`` tells whether decoding the ids gives the text again; the one loss is a visible space in the text, which
    decodes to a space.  Whole texts are encoded; null and empty texts have no ids.  Rows are encoded alone, so repeated
    rows get equal results; other columns pass through and must not have the new names.  An empty table gives no rows.
    ``model`` names a model file that every executor has at the same path.
    """
    path = model or default_model()
    rest = [c for c in docs.columns if c != text]

    def run(batches):
        m = compiled(path)
        for whole in batches:
            bytes_ = pc.fill_null(pc.binary_length(whole.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(bytes_) // TOGETHER
            for at in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
                b = whole.slice(at, int(np.searchsorted(part, part[at], "right")) - at)
                ids, sizes, exact = m.encode_all(b.column(0))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                spelt = np.concatenate([[0], np.cumsum(m.is_byte[ids])])[ends]
                listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[1:], listed, pa.array(sizes), pa.array(np.diff(spelt)), pa.array(exact)], names=[*rest, "ids", "n_tokens", "n_bytes", "exact"]
                )

    schema = StructType([*docs.select(*rest).schema.fields, StructField("ids", ArrayType(IntegerType()))])
    schema = schema.add("n_tokens", "long").add("n_bytes", "long").add("exact", "boolean")
    return docs.select(F.col(text), *rest).mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """``tokens`` with the text of its ids as ``text`` in place of the ids.

    Null ids give null, no ids the empty text; rows are decoded alone, so repeated rows get equal texts.  Other columns pass
    through and must not be named ``text``.  An empty table gives no rows.
    """
    path = model or default_model()
    rest = [c for c in tokens.columns if c != ids]

    def run(batches):
        m = compiled(path)
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], names=[*rest, "text"])

    return tokens.select(F.col(ids), *rest).mapInArrow(run, tokens.select(*rest).schema.add("text", "string"))
