"""Bounds on every column of a signal table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bounds import bound_labels
from ..functions.text import truncate_utf8

#: Bytes of a string and of an id, elements of an argument list and of a stack.
STRING, ID, ARGUMENTS, FRAMES = 256, 64, 32, 256


def sanitize(df: DataFrame, whole: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with strings, ids, arguments, frames and labels within their caps (P2); columns in ``whole`` stay as they are."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in whole:
            continue
        if isinstance(f.dataType, T.StringType):
            out[f.name] = truncate_utf8(c, ID if f.name.endswith("_id") else STRING)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out[f.name] = F.transform(F.slice(c, 1, ARGUMENTS), lambda a: truncate_utf8(a, STRING))
        elif isinstance(f.dataType, T.ArrayType) and f.name in ("frames", "stack_frames"):
            out[f.name] = F.slice(c, 1, FRAMES)
        elif isinstance(f.dataType, T.MapType):
            out[f.name] = bound_labels(c)
    return df.withColumns(out) if out else df
