"""Canonical text, row hashes and order-independent table fingerprints."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Fixed value: text of a null (and of an empty string) in a row hash.
NULL_TOKEN = ":"


def canonical_text(field: T.StructField, alias: str = "") -> Column:
    """The text of a column that equal values share in every engine; null for null and for the empty string."""
    c, kind = F.col(f"{alias}.`{field.name}`" if alias else f"`{field.name}`"), field.dataType
    if isinstance(kind, T.BooleanType):
        return F.when(c, "T").when(~c, "F")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # six decimals where they are the whole value, else the shortest text that reads back as the same number
        fixed = c.try_cast("decimal(38,6)")
        return F.when(fixed.cast(kind) == c, fixed.cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return F.nullif(c.cast("string"), F.lit(""))


def row_hash(fields: list[T.StructField], alias: str = "") -> Column:
    """SHA-256 over the length-prefixed canonical texts of the columns."""
    part = lambda t: F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit(NULL_TOKEN))
    return F.sha2(F.concat_ws("|", *[part(canonical_text(f, alias)) for f in fields]), 256)


@dataclass(frozen=True)
class Fingerprint:
    """Row count and two exact sums of 60-bit slices of the row hashes: a commutative group under addition."""

    n: int = 0
    s1: int = 0
    s2: int = 0

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.n + other.n, self.s1 + other.s1, self.s2 + other.s2)

    def __sub__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.n - other.n, self.s1 - other.s1, self.s2 - other.s2)

    def __str__(self) -> str:
        return f"{self.n}:{self.s1}:{self.s2}"


def fingerprint_sums(h: Column | str) -> list[Column]:
    """Aggregates (n, s1, s2) over a column of row hashes; zero, not null, over no rows."""
    h = F.col(h) if isinstance(h, str) else h
    slice_ = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)")
    return [F.count(h).alias("n"), total(slice_(1)).alias("s1"), total(slice_(16)).alias("s2")]


def hashed(df: DataFrame, key: str | None = None) -> DataFrame:
    """(k, h): key text and row hash; k is null for keyless tables."""
    k = canonical_text(df.schema[key]) if key else F.lit(None).cast("string")
    return df.select(k.alias("k"), row_hash(df.schema.fields).alias("h"))


def fingerprint(df: DataFrame) -> Fingerprint:
    r = hashed(df).agg(*fingerprint_sums("h")).first()
    return Fingerprint(int(r["n"]), int(r["s1"]), int(r["s2"]))


def signature(df: DataFrame) -> str:
    """The schema as text, to tell whether a table's shape has changed."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
