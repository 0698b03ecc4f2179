"""Differences between two copies of a table by a column-by-bucket checksum matrix.

Each copy is reduced to one row per key bucket that holds, for each column, the sum of a 64-bit hash over
(key, column, value), plus a second independent hash of the whole row.  Sums are additive, so they combine map-side
and the shuffle carries at most one row per bucket and task, whatever the table's size.  Buckets whose sums are equal
are equal up to a chance of about 2**-128; only rows of unequal buckets are read again, with the values of equal
columns left out, and joined by key.

How many rows differ shows in how many buckets do.  Where a first matrix leaves more than CROWDED of its buckets unequal,
a second one is made of four times as many buckets as rows are estimated to differ, but of no more than a quarter of the
rows, beyond which a matrix would be no smaller than the table.  Columns that are equal in all buckets aren't read again.

Values are compared in canonical text: null equals the empty string, times are cut to the millisecond.

Edge cases: rows repeated in all columns count once; a null key counts as the empty key; if a copy holds several
different rows for one key, a column is equal when its smallest and its largest value are equal on both sides; an
empty copy makes every row of the other one ADDED or DELETED; extra columns that are not compared are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.session import broadcast_small, scratch

#: Bucket lists of at most this many entries (some 2 MB) are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_BUCKETS = 1 << 17
#: Buckets of the first matrix, and the share of unequal ones from which a finer matrix is made.
BUCKETS, CROWDED = 1 << 16, 0.4


def canonical(df: DataFrame, name: str) -> Column:
    """Canonical text of a column, never null."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def _prepared(df: DataFrame, columns: list[str], key: str, buckets: int) -> DataFrame:
    out = df.select(*[canonical(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    return out.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), f"v{columns.index(key)}"), F.lit(buckets)).cast("int"))


def _halves(h: Column) -> tuple[Column, Column]:
    """A 64-bit hash as two numbers whose sums can't overflow below 2**31 rows a bucket."""
    return F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))


def checksum_matrix(df: DataFrame, columns: list[str], key: str, buckets: int) -> DataFrame:
    """One row per bucket: the row count, a guard over whole rows and the wide sum of every column."""
    rows = _prepared(df, columns, key, buckets)
    k, n = f"v{columns.index(key)}", range(len(columns))
    sums = [F.count(F.lit(1)).alias("n")]
    hashed = {"g": F.xxhash64(F.lit("guard"), *[f"v{i}" for i in n])} | {f"c{i}": F.xxhash64(F.lit(i), k, f"v{i}") for i in n}
    for name, h in hashed.items():
        hi, lo = _halves(h)
        sums += [F.sum(hi).alias(f"{name}_hi"), F.sum(lo).alias(f"{name}_lo")]
    return rows.groupBy("bucket").agg(*sums)


def unequal_buckets(left: DataFrame, right: DataFrame, columns: list[str], key: str, buckets: int) -> DataFrame:
    """(bucket, unequal): buckets whose sums differ, with a bit for every column to be read."""
    l, r = checksum_matrix(left, columns, key, buckets).alias("l"), checksum_matrix(right, columns, key, buckets).alias("r")
    same = lambda name: F.col(f"l.{name}_hi").eqNullSafe(F.col(f"r.{name}_hi")) & F.col(f"l.{name}_lo").eqNullSafe(F.col(f"r.{name}_lo"))
    bits = reduce(lambda a, b: a + b, [F.when(same(f"c{i}"), F.lit(0)).otherwise(F.lit(1 << i)).cast("bigint") for i in range(len(columns))])
    everything = F.lit((1 << len(columns)) - 1).cast("bigint")
    return (
        l.join(r, F.col("l.bucket") == F.col("r.bucket"), "full_outer")
        .select(
            F.coalesce("l.bucket", "r.bucket").alias("bucket"),
            (same("g") & F.col("l.n").eqNullSafe(F.col("r.n"))).alias("equal"),
            bits.alias("unequal"),
        )
        .where(~F.col("equal"))
        .select("bucket", F.when(F.col("unequal") == 0, everything).otherwise(F.col("unequal")).alias("unequal"))
    )


def checksum_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(key_value, class, cols_mask) of every key that is ADDED (only right), DELETED (only left) or CHANGED.

    ``buckets`` are those of the first matrix.  Bit i of ``cols_mask`` stands for column i of ``columns``; ADDED and DELETED have all bits set.
    """
    columns = columns or left.columns
    if len(columns) > 62:
        raise ValueError("a mask holds at most 62 columns")
    ki, n = columns.index(key), len(columns)
    area = scratch(left.sparkSession)
    todo = area.table(unequal_buckets(left, right, columns, key, buckets), "buckets")
    seen = todo.agg(F.count(F.lit(1)).alias("n"), F.bit_or("unequal").alias("bits")).first()
    if seen["n"] > CROWDED * buckets:
        share = min(seen["n"], buckets - 1) / buckets
        finer = 1 << max(0, round(-buckets * math.log(1 - share) * 4) - 1).bit_length()
        finer = min(finer, 1 << max(1, (left.count() + right.count()) // 8).bit_length(), 1 << 30)
        if finer > buckets:
            buckets = finer
            todo = area.table(unequal_buckets(left, right, columns, key, buckets), "buckets")
            seen = todo.agg(F.count(F.lit(1)).alias("n"), F.bit_or("unequal").alias("bits")).first()
    todo = broadcast_small(todo, MAX_BROADCAST_BUCKETS)
    read = [i for i in range(n) if i != ki and (seen["bits"] or 0) >> i & 1]  # the others are equal everywhere

    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = _prepared(df, [columns[i] for i in [ki, *read]], key, buckets)  # v0 is the key
        rows = rows.join(todo, "bucket")
        needed = [F.when(F.col("unequal").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"v{at}")).alias(f"w{i}") for at, i in enumerate(read, 1)]
        rows = rows.select(F.col("v0").alias("k"), *needed)
        bounds = [f(f"w{i}").alias(f"{tag}{x}{i}") for i in read for f, x in ((F.min, "a"), (F.max, "z"))]
        return rows.groupBy("k").agg(F.first(F.lit(1)).alias(f"{tag}here"), *bounds)

    both = side(left, "l").join(side(right, "r"), "k", "full_outer")
    differs = lambda i: ~(F.col(f"la{i}").eqNullSafe(F.col(f"ra{i}")) & F.col(f"lz{i}").eqNullSafe(F.col(f"rz{i}")))
    mask = reduce(lambda a, b: a + b, [F.when(differs(i), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in read], F.lit(0).cast("bigint"))
    whole = F.lit((1 << n) - 1).cast("bigint")
    return (
        both.withColumn("class", F.when(F.col("lhere").isNull(), "ADDED").when(F.col("rhere").isNull(), "DELETED").otherwise("CHANGED"))
        .withColumn("cols_mask", F.when(F.col("class") == "CHANGED", mask).otherwise(whole))
        .where("cols_mask <> 0")
        .select(F.col("k").alias("key_value"), "class", "cols_mask")
    )
