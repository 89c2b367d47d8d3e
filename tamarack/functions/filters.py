"""Metadata filters: a conjunction of equalities and memberships, with the equality of JSON values."""

from __future__ import annotations

import functools
import json
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|FLOAT|DOUBLE)$"


def _path(key: str) -> str:
    if "'" in key:
        raise ValueError(f"Filter key {key!r} holds a quotation mark")
    return f"$['{key}']"


def _structural(metadata: Column, key: str, value) -> Column:
    """Equality with a list or an object, by Python on parsed values."""

    @F.pandas_udf(T.BooleanType())
    def same(column: pd.Series) -> pd.Series:
        def one(m):
            try:
                return json.loads(m).get(key) == value
            except (TypeError, ValueError, AttributeError):
                return False

        return column.map(one)

    return same(metadata)


def _scalar(metadata: Column, key: str, value) -> Column:
    parsed = F.try_parse_json(metadata)
    one = F.try_variant_get(parsed, _path(key), "variant")
    kind = F.schema_of_variant(one)
    if value is None:
        return one.isNull() | (kind == "VOID")
    if isinstance(value, str):
        return F.coalesce((kind == "STRING") & (F.try_variant_get(one, "$", "string") == value), F.lit(False))
    number = F.when(kind == "BOOLEAN", F.try_variant_get(one, "$", "boolean").cast("double")).when(kind.rlike(NUMERIC), F.try_variant_get(one, "$", "double"))
    return F.coalesce(number == float(value), F.lit(False))


def compile_filter(criteria: dict | None, metadata: str = "metadata", typed: dict[str, str] | None = None) -> Column:
    """A predicate for ``criteria``; every key must hold, an empty or missing filter always does.

    A list means membership. 1, 1.0 and true are equal, "1" isn't; a missing key is null, and
    ``{"k": None}`` matches both. ``typed`` names columns that hold a key's value already: these
    predicates reach the scan.
    """
    typed = typed or {}

    def equal(key: str, value) -> Column:
        if key in typed:
            c = F.col(typed[key])
            return c.isNull() if value is None else c == value  # null where the key is missing, so that the scan can take it
        if isinstance(value, (list, dict)):
            return _structural(F.col(metadata), key, value)
        return _scalar(F.col(metadata), key, value)

    parts = []
    for key, value in (criteria or {}).items():
        if isinstance(value, list):
            if key in typed and value and all(v is not None and not isinstance(v, (list, dict)) for v in value):
                parts.append(F.col(typed[key]).isin(value))
            else:
                parts.append(functools.reduce(operator.or_, (equal(key, v) for v in value), F.lit(False)))
        else:
            parts.append(equal(key, value))
    return functools.reduce(operator.and_, parts, F.lit(True))
