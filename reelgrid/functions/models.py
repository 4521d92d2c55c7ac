"""Slots for neural models.

A slot has a name, input columns and a result type. ``apply_model`` runs the
registered vectorised function, or the slot's stand-in, which derives values
from an MD5 of its name and input, so that plans can be run and held against
SQL without weights. A null input gives a null result.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

_SCORES = "array<struct<label:string,prob:double>>"

#: name -> (result type, labels of its stand-in)
SLOTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "transcribe": ("array<struct<start:double,end:double,text:string,speaker:string>>", ()),
    "embed_audio": ("array<float>", ()),
    "tag_audio": (_SCORES, ("Speech", "Music", "Silence")),
    "speaker_attributes": (_SCORES, ("neutral", "happy", "sad", "angry")),
    "tag_text": ("array<struct<word:string,upos:string,start_char:int,end_char:int>>", ()),
    "sentiment": (_SCORES, ("positive", "negative", "neutral")),
    "evaluate_text": ("string", ("evaluative", "non-evaluative")),
    "embed_text": ("array<float>", ()),
    "shot_boundaries": ("array<double>", ()),
    "embed_image": ("array<float>", ()),
    "embed_action": ("array<float>", ()),
    "shot_scale": (_SCORES, ("extreme close-up", "close-up", "medium", "full", "long")),
    "shot_angle": (_SCORES, ("low", "eye", "high")),
    "detect_layout": (_SCORES, ("person", "tv", "chair")),
    "answer_image": ("string", ("A", "B", "C")),
    "detect_faces": ("array<struct<x:double,y:double,w:double,h:double,score:double>>", ()),
    "face_emotion": (_SCORES, ("angry", "disgust", "fear", "happy", "neutral", "sad", "surprise")),
    "head_gaze": ("array<double>", ()),
    "speaking_score": ("array<double>", ()),
    "caption": ("string", ("a person", "a street", "a studio")),
}
_word = re.compile(r"\S+", re.ASCII).finditer
_REGISTERED: dict[str, Callable[[pd.Series], pd.Series]] = {}


def register(name: str, f: Callable[[pd.Series], pd.Series]) -> None:
    """Use ``f`` for a slot: a series of inputs to a series of results of the slot's type."""
    if name not in SLOTS:
        raise KeyError(name)
    _REGISTERED[name] = f


@contextmanager
def registered(name: str, f: Callable[[pd.Series], pd.Series]):
    """``f`` serves the slot inside the block; what served it before returns afterwards."""
    before = _REGISTERED.get(name)
    register(name, f)
    try:
        yield
    finally:
        if before is None:
            del _REGISTERED[name]
        else:
            _REGISTERED[name] = before


def _stand_in(name: str):
    kind, labels = SLOTS[name]

    def one(value):
        if value is None:
            return None
        h = hashlib.md5(f"{name}:{value}".encode()).hexdigest()
        unit = [int(h[2 * i : 2 * i + 2], 16) / 255 for i in range(8)]
        if kind == "string":
            return labels[int(h[:12], 16) % len(labels)]
        if kind == _SCORES:
            raw = [unit[i] + 0.01 for i in range(len(labels))]
            # Added one by one, as SQL adds; ``sum`` compensates since Python 3.12.
            total = reduce(operator.add, raw)
            return [{"label": x, "prob": r / total} for x, r in zip(labels, raw, strict=True)]
        if kind in ("array<float>", "array<double>"):
            return unit
        if name == "transcribe":
            return [{"start": unit[0], "end": unit[0] + unit[1], "text": h[:8], "speaker": f"S{int(h[8], 16) % 3}"}]
        if name == "tag_text":
            return [{"word": m.group(), "upos": "NOUN" if m.group()[0].isupper() else "X", "start_char": m.start(), "end_char": m.end()} for m in _word(value)]
        return [{**dict(zip("xywh", unit[:4], strict=True)), "score": unit[4]}]

    return lambda series: series.map(one)


#: Bytes of text and number of values that a slot's function gets at once, beyond one value. Results may be many times as large.
PIECE_BYTES, PIECE_ROWS = 1 << 19, 500


def _pieces(values: pa.Array):
    """(start, length) of pieces of ``values``, one value at least."""
    text = pa.types.is_string(values.type) or pa.types.is_binary(values.type)
    upto = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if text else np.zeros(len(values), np.int64)
    at = 0
    while at < len(values):
        fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE_BYTES, side="right"))
        end = min(at + PIECE_ROWS, max(at + 1, fits))
        yield at, min(end, len(values)) - at
        at = end


def apply_model(df: DataFrame, name: str, value: Column, out: str) -> DataFrame:
    """``df`` with the slot's result; Arrow batches, no Python call a row in the JVM."""
    return apply_models(df, {out: name}, value, [c for c in df.columns if c != out])


def apply_models(df: DataFrame, slots: dict[str, str], value: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``df``, and a column of results for each slot in ``slots`` (column: name), all over one value.

    All slots see a piece of the values together, and its results leave Python
    before those of the next are made. Workers are handed ``PIECE_ROWS`` rows at
    once; that setting stays in the session, as results are made after the caller has returned.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PIECE_ROWS))
    rows = df.select(*keep, value.alias("_value"))
    fs = {out: _REGISTERED.get(name) or _stand_in(name) for out, name in slots.items()}
    types = {out: DataType.fromDDL(SLOTS[name][0]) for out, name in slots.items()}
    kinds = {out: to_arrow_type(kind) for out, kind in types.items()}

    def run(batches):
        for batch in batches:
            for at, n in _pieces(batch.column(len(keep))):
                own = batch.slice(at, n)
                piece = own.column(len(keep)).to_pandas()
                results = [pa.Array.from_pandas(f(piece), type=kinds[out]) for out, f in fs.items()]
                yield pa.RecordBatch.from_arrays([*own.columns[: len(keep)], *results], names=[*keep, *fs])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *[StructField(out, kind) for out, kind in types.items()]]))
