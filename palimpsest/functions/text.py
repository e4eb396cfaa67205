"""String semantics of the snapshot format, as Column expressions.

Sizes are UTF-16 code units, and white space is the wide set of ECMAScript; Java's and Python's
own notions differ, so both are spelled out here.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space and line ends of ECMAScript, as the inside of a character class (fixed values).
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Names that suggest map data (fixed values).
MAP_WORDS = "map|data|location|region|marker|route|path|feature|geo|world"

_RUN = re.compile(f"[{SPACE}]*\n[{SPACE}]*")
_EDGE = re.compile(f"^[{SPACE}]+|[{SPACE}]+$")


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean(s: Column) -> Column:
    """No-break spaces to spaces, runs of blanks to one, white space around a line end to one line end."""
    s = F.regexp_replace(F.translate(s, "\u00a0", " "), "[ \t]+", " ")
    return trim(F.regexp_replace(s, f"[{SPACE}]*\n[{SPACE}]*", "\n"))


def clean_text(s: str) -> str:
    """``clean`` for Python code that holds a tree in its hands."""
    return _EDGE.sub("", _RUN.sub("\n", re.sub("[ \t]+", " ", s.replace("\u00a0", " "))))


def units(s: str) -> int:
    """``utf16_length`` of a Python string."""
    return len(s) if s.isascii() else len(s.encode("utf-16-le")) // 2


def slug_text(s: str) -> str:
    """ASCII letters and digits of the decomposed lower case, joined by single hyphens."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", clean_text(s).lower()) if not "\u0300" <= c <= "\u036f")
    joined = re.sub("[^a-z0-9]+", "-", plain)
    return joined.removeprefix("-").removesuffix("-") or "untitled"


def name_key_text(s: str) -> str:
    """Letters and digits of the compatibility-composed lower case, joined by hyphens."""
    folded = unicodedata.normalize("NFKC", _EDGE.sub("", s)).lower()
    return "-".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded).split(" ")).strip("-") if folded else ""


def _key(s: str | None) -> str | None:
    return None if s is None else re.sub("-+", "-", name_key_text(s))


@F.pandas_udf(T.StringType())
def slug(s: pd.Series) -> pd.Series:
    return s.map(slug_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def name_key(s: pd.Series) -> pd.Series:
    return s.map(_key, na_action="ignore")


def cell(s: Column) -> Column:
    """A value inside a Markdown table: bars escaped, line ends as spaces, a dash for nothing."""
    t = F.translate(F.replace(trim(F.coalesce(s, F.lit(""))), F.lit("|"), F.lit("\\|")), "\n", " ")
    return F.when(t == "", F.lit("—")).otherwise(t)


def yaml_scalar(value) -> str:
    """Front matter values: bare numbers and booleans, inline lists, quoted strings."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(yaml_scalar, value)) + "]"
    return json.dumps(str(value), ensure_ascii=False)
