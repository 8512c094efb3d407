"""Identity functions: the normal form of ids and labels.

The normal form is: NFKC, every run of characters other than letters, digits and ``_`` to one
``_``, runs of ``_`` to one, ``_`` stripped at both ends, case folded. It is idempotent.
ASCII values stay in the JVM; only others cross to Python (they are sent as nulls otherwise).
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NOT_WORD = re.compile(r"[^\w]+")
_UNDERSCORES = re.compile(r"_+")


def normalize_id_py(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    return _UNDERSCORES.sub("_", _NOT_WORD.sub("_", text)).strip("_").casefold()


def make_id_py(*parts: str) -> str:
    return normalize_id_py("_".join(p for p in (x.strip("_.") for x in parts if x) if p))


@F.pandas_udf(StringType())
def _normalize_other(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else normalize_id_py(x))


_normalize_other = _normalize_other.asNondeterministic()  # else filters on its result would be pushed below it and run it twice


def is_ascii(c: Column) -> Column:
    """As many bytes as characters: no pattern has to run."""
    return F.octet_length(c) == F.length(c)


def normalize_id(c: Column | str) -> Column:
    """Normal form of an id; null stays null, an id without letters or digits becomes ''."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(is_ascii(c), plain).otherwise(_normalize_other(F.when(~is_ascii(c), c)))


def make_id(*parts: Column) -> Column:
    """Parts without ``_`` and ``.`` at their ends, joined by ``_``, in normal form; null or
    empty parts are left out."""
    clean = [F.regexp_replace(p, r"^[_.]+|[_.]+$", "") for p in parts]
    return normalize_id(F.array_join(F.filter(F.array(*clean), lambda x: x != ""), "_"))
