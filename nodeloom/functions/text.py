"""Text functions: searchable forms of labels, names for files and output formats."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nodeloom.functions.ids import is_ascii


def strip_diacritics_py(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def _search_form_other(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else strip_diacritics_py(x).lower())


_search_form_other = _search_form_other.asNondeterministic()  # else filters on its result would be pushed below it and run it twice


def search_form(c: Column) -> Column:
    """Lower case without diacritics; null becomes ''. ASCII stays in the JVM."""
    c = F.coalesce(c, F.lit(""))
    return F.when(is_ascii(c), F.lower(c)).otherwise(_search_form_other(F.when(~is_ascii(c), c)))


def tokens(form: Column) -> Column:
    """Words of a search form."""
    return F.regexp_extract_all(form, F.lit(r"[\p{L}\p{N}_]+"), 0)


def token_text(form: Column) -> Column:
    return F.array_join(tokens(form), " ")


def trigrams(text: Column) -> Column:
    """Distinct character trigrams; a shorter text is its own only gram, '' has none."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) < 3, F.array(text)).otherwise(F.array_distinct(grams))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character, 0 for ''."""
    n = F.length(text)
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - part(c) * F.log2(part(c)))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def entropy_py(text: str) -> float:
    import math
    from collections import Counter

    return -sum(k / len(text) * math.log2(k / len(text)) for k in Counter(text).values()) if text else 0.0


def bare_name(label: Column) -> Column:
    """Lower-cased label without the call brackets at its end (ASCII letters; see README)."""
    return F.regexp_replace(F.lower(label), r"\(\)$", "")


def callable_key(label: Column) -> Column:
    """A symbol's name without brackets at its ends, leading dots and letter case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(label), r"^[()]+|[()]+$", ""), r"^\.+", ""))


def word_count(text: Column) -> Column:
    """Words divided by white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """Four characters a token, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def file_tokens(chars: Column, most: int = 20_000, overhead: int = 160) -> Column:
    """Estimated tokens of a file of so many characters when sent as a prompt."""
    return F.floor((F.least(chars, F.lit(most)) + overhead) / 4).cast("long")


# names and escapes for output formats


def cypher_escape(c: Column) -> Column:
    """For a quoted literal: control characters but tabs dropped, ``\\`` and ``'`` escaped."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0a-\x1f]", "")
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def cypher_name(c: Column, fallback: str) -> Column:
    """Letters, digits and ``_``, starting with a letter, else ``fallback``."""
    kept = F.regexp_replace(c, r"[^A-Za-z0-9_]", "")
    return F.when(kept.rlike("^[A-Za-z]"), kept).otherwise(F.lit(fallback))


def safe_filename(c: Column, most: int = 200) -> Column:
    """A label as a file name: ``/`` and ``:`` to ``-``, blanks and other reserved signs to ``_``,
    dots and blanks off the ends; 'unnamed' if nothing is left."""
    name = F.regexp_replace(F.translate(c, "/ :", "-_-"), r'[<>"\\|?*]', "_")
    name = F.substring(F.regexp_replace(name, r"^[. ]+|[. ]+$", ""), 1, most)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unnamed")).otherwise(name)


def cap_filename_py(name: str, most: int = 200) -> str:
    """Names over ``most`` bytes end in a hash of the whole."""
    raw = name.encode()
    if len(raw) <= most:
        return name
    return raw[: most - 9].decode(errors="ignore") + "_" + hashlib.sha256(raw).hexdigest()[:8]


def yaml_string(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def tag(c: Column) -> Column:
    """A note tag: blanks to ``_``, other than letters, digits, ``_ - /`` dropped."""
    return F.regexp_replace(F.regexp_replace(c, " ", "_"), r"[^A-Za-z0-9_\-/]", "")


def ascii_id(c: Column) -> Column:
    """Stable ASCII identifier: the readable part, or n_ and a hash if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(kept != "", kept).otherwise(F.concat(F.lit("n_"), F.substring(F.sha1(c.cast("binary")), 1, 10)))


def humanize(c: Column) -> Column:
    """snake_case, kebab-case and camelCase to words."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def strip_version(c: Column) -> Column:
    """A package reference up to the ``@`` of its version: ``@scope/name@1.2`` to ``@scope/name``."""
    return F.regexp_replace(c, r"^(@?[^@]*)@.*$", "$1")


def requirement_name(c: Column) -> Column:
    """Distribution name of a requirement line, '' if there is none."""
    return F.regexp_extract(c, r"^\s*([A-Za-z0-9][A-Za-z0-9._\-]*)", 1)


def parse_time(c: Column) -> Column:
    """ISO date or time as UTC time; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(c, r"Z$", "+00:00"))


_WORD = re.compile(r"\w+")


def has_chinese(text: str) -> bool:
    return any("一" <= c <= "鿿" for c in text)


def query_terms(question: str) -> list[str]:
    """Search terms of a question: words in lower case, ASCII words of one or two letters left
    out; Chinese runs as character pairs and, if longer, as a whole."""
    terms = []
    for raw in question.lower().split():
        if has_chinese(raw):
            pairs = [raw[i : i + 2] for i in range(len(raw) - 1)] or [raw]
            terms += [*pairs, *([raw] if len(raw) > 1 and raw not in pairs else [])]
        else:
            terms += _WORD.findall(raw)
    return [t for t in terms if t.strip() and (len(t) > 2 or not re.fullmatch("[a-z]+", t))]
