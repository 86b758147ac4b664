"""Column helpers: type splits, quoting, legal names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str):
    """Column by name, safe for names with spaces or dots (``term_ 60 months``)."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def type_name(dt: T.DataType) -> str:
    return dt.simpleString()


_ILLEGAL = re.compile(r"[^A-Za-z0-9._]")


def legal_names(names: list[str]) -> list[str]:
    """Illegal characters -> '.', a leading digit or '_' gets an 'X' prefix,
    duplicates get '.1', '.2', ... in order of appearance."""
    out, seen = [], {}
    base = []
    for n in names:
        s = _ILLEGAL.sub(".", n)
        if not s or s[0].isdigit() or s[0] == "_":
            s = "X" + s
        base.append(s)
    taken = set(base)
    for s in base:
        if s not in seen:
            seen[s] = 0
            out.append(s)
            continue
        i = seen[s]
        while True:
            i += 1
            cand = f"{s}.{i}"
            if cand not in taken:
                break
        seen[s] = i
        taken.add(cand)
        out.append(cand)
    return out


_NOT_WORD = re.compile(r"[^A-Za-z0-9_]")


def ml_names(names: list[str]) -> list[str]:
    """Names usable as ML input columns: no dots or spaces (``term_ 60 months`` ->
    ``term__60_months``); duplicates get ``_1``, ``_2``."""
    out, seen = [], set()
    for n in names:
        s = _NOT_WORD.sub("_", n)
        c, i = s, 0
        while c in seen:
            i += 1
            c = f"{s}_{i}"
        seen.add(c)
        out.append(c)
    return out
