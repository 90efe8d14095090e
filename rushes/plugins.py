"""Where models and user functions plug in.  None are shipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushes.functions.media import query_gate
from rushes.operators.tracking import apply_state  # noqa: F401 - the keyed-state surface

_DETECTORS: dict[str, Callable[[Column], Column]] = {}


def apply_model(
    df: DataFrame, loader: Callable[[], Any], fn: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Run a model over all rows: ``loader()`` once per task, ``fn(model, batch)`` per Arrow batch.

    Select only the columns the model needs and filter first; what is not needed is then never sent to Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            if model is None:
                model = loader()
            yield fn(model, pdf)

    return df.mapInPandas(run, schema)


def apply_encoder(
    df: DataFrame, loader: Callable[[], Any], encode: Callable[[Any, pd.Series], list], col: str, keys: Sequence[str]
) -> DataFrame:
    """Embedding rows (keys, ``embedding``) for a text or image-reference column."""

    def fn(model: Any, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[list(keys)].assign(embedding=list(encode(model, pdf[col])))

    fields = [f for f in df.select(*keys).schema.fields]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", embedding array<double>"
    return apply_model(df.select(*keys, col), loader, fn, ddl)


def register_language_detector(name: str, detect: Callable[[pd.Series], pd.Series]) -> None:
    """Make a vectorised language detector (texts to codes or None) available to ``gate_queries``."""

    def run(texts: pd.Series) -> pd.Series:
        return detect(texts)

    _DETECTORS[name] = F.pandas_udf(run, "string")


def gate_queries(queries: DataFrame, detector: str, text: str = "text") -> DataFrame:
    """Add ``source_lang`` and ``needs_translation`` using a registered detector; short texts are not detected."""
    if detector not in _DETECTORS:
        raise KeyError(f"no language detector named {detector}")
    detected = queries.withColumn("_lang", _DETECTORS[detector](F.col(text)))
    return detected.withColumn("_gate", query_gate(text, "_lang")).select(*queries.columns, "_gate.*")
