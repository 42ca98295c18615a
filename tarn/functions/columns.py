"""Column functions of the data model, all of them built from JVM-side expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob: * is any run, ? any one character, all else itself."""
    parts = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(parts.get(c) or re.sub(r"([^\w])", r"\\\1", c) for c in pattern) + "$"


def ttl_ms(expires_at: Column, now_ms: int) -> Column:
    """Milliseconds left: -1 without expiry, never under 0."""
    return F.when(expires_at.isNull(), F.lit(-1)).otherwise(F.greatest(expires_at - now_ms, F.lit(0))).cast("long")


def ttl_seconds(expires_at: Column, now_ms: int) -> Column:
    return F.when(expires_at.isNull(), F.lit(-1)).otherwise(F.floor(F.greatest(expires_at - now_ms, F.lit(0)) / 1000)).cast("long")


def live(expires_at: Column, now_ms: int) -> Column:
    return expires_at.isNull() | (expires_at >= now_ms)


# arrays as lists: negative indexes count from the tail, ranges are inclusive and clamped


def from_head(index: Column, size: Column) -> Column:
    return F.when(index < 0, index + size).otherwise(index)


def list_index(items: Column, index: Column | int) -> Column:
    return F.get(items, from_head(F.lit(index), F.size(items)))


def list_range(items: Column, start: Column | int, stop: Column | int) -> Column:
    first = F.greatest(from_head(F.lit(start), F.size(items)), F.lit(0))
    last = F.least(from_head(F.lit(stop), F.size(items)), F.size(items) - 1)
    return F.when(first <= last, F.slice(items, first + 1, F.greatest(last - first + 1, F.lit(0)))).otherwise(F.slice(items, 1, 0))


def list_set(items: Column, index: int, value: Column) -> Column:
    """items with the one at index replaced; null (an error) where the index is out of range."""
    at = from_head(F.lit(index), F.size(items))
    return F.when((at >= 0) & (at < F.size(items)), F.transform(items, lambda x, i: F.when(i == at, value).otherwise(x)))


# maps as hashes


def hash_get(fields: Column, *names: str) -> Column:
    """Values of the named fields in the order asked for, null where there is none."""
    return F.array(*(F.try_element_at(fields, F.lit(n)) for n in names))


def hash_set(fields: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(fields, lambda k, _: ~F.map_contains_key(new, k)), new)


def hash_delete(fields: Column, *names: str) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(*names))


# vectors


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """v scaled to length 1; the zero vector as it is. The norm is bound to a variable, so it is computed once, not per element."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))[0]


def similarity(v: Column, query: list[float]) -> Column:
    """Cosine of v and a query in double precision; 0 where either is zero."""
    size = sum(x * x for x in map(float, query)) ** 0.5
    unit = F.array(*(F.lit(float(x) / size if size else 0.0) for x in query))
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, dot(v, unit) / n).otherwise(0.0))[0]


def memory_score(similarity: Column, age: Column, half_life: float, importance: Column, uses: Column) -> Column:
    """Similarity, halved with every half-life of age, times importance, times min(1, log2(uses + 1) / 10)."""
    return similarity * F.pow(F.lit(0.5), age / half_life) * importance * F.least(F.lit(1.0), F.log2(uses + 1) / 10)
