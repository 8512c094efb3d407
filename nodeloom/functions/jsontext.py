"""JSON as models and tools write it: tolerant reading, bounded metadata."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MOST_CHARS, MOST_VALUE, MOST_ITEMS = 10_000_000, 512, 50
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def read_object_py(text: str | None) -> dict | None:
    """The JSON object in a text: as it is, in a fenced block, or from the first brace on; lists of
    nodes without an object around them count as {"nodes": ...}. None if there is none."""
    if not text or len(text) > MOST_CHARS:
        return None
    tries = [text.strip(), *(m.strip() for m in re.findall(r"```(?:json)?\s*\n(.*?)```", text, re.S))]
    for t in tries:
        try:
            got = json.loads(t)
        except (ValueError, RecursionError):
            continue
        if isinstance(got, dict):
            return got
        if isinstance(got, list) and all(isinstance(x, dict) for x in got):
            return {"nodes": got}
    decoder = json.JSONDecoder()
    for at in (m.start() for m in re.finditer(r"\{", text)):
        try:
            got, _ = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            continue
        if isinstance(got, dict):
            return got
        break
    return None


def clean_py(value):
    """A value without control characters, HTML-escaped, with bounded strings and lists; entries
    whose key comes out empty are dropped."""
    if isinstance(value, (bool, int, float)) or value is None:
        return value
    if isinstance(value, dict):
        return {k: clean_py(v) for k, v in ((clean_py(str(k)), v) for k, v in value.items()) if k}
    if isinstance(value, (list, tuple)):
        return [clean_py(v) for v in value[:MOST_ITEMS]]
    return html.escape(_CONTROL.sub("", str(value)), quote=True)[:MOST_VALUE]


@F.pandas_udf(StringType())
def read_object(values: pd.Series) -> pd.Series:
    """The object as compact JSON, null if there is none."""
    got = values.map(read_object_py)
    return got.map(lambda x: None if x is None else json.dumps(x, ensure_ascii=False))


@F.pandas_udf(StringType())
def sanitize_metadata(values: pd.Series) -> pd.Series:
    """Metadata as JSON text, cleaned; '{}' for null or anything but an object."""
    got = values.map(lambda x: clean_py(read_object_py(x) or {}))
    return got.map(lambda x: json.dumps(x, ensure_ascii=False))
