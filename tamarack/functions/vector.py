"""Vector arithmetic as columns, in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, how: str = "store") -> Column:
    """``store``: v / (norm + eps), as records are kept; ``embed``: v / max(norm, eps), as embedders give them."""
    length = norm(v) + EPS if how == "store" else F.greatest(norm(v), F.lit(EPS))
    # as the only element of an array the length is found once, not again for each element
    return F.transform(F.array(length), lambda n: F.transform(v, lambda x: x.cast("double") / n)).getItem(0)


def unit_literal(values: Sequence[float]) -> Column:
    """A query vector, normalised as records are."""
    length = math.sqrt(sum(float(x) * float(x) for x in values)) + EPS
    return literal([float(x) / length for x in values])


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
