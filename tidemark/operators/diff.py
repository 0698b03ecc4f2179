"""Exact differences of a branch against the hashes taken when it was opened."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.hashing import canonical_text, hashed, row_hash

#: A bigint mask holds this many columns.
MASK_COLUMNS = 60


def keyed_diff(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """(key_value, class, cols_mask, base_hash, head_hash) of rows ADDED, CHANGED or DELETED in ``head``.

    One full outer join by key carries the hashes and the texts of both sides, so each side is read and shuffled once.
    Bit i of the mask stands for column i of ``base``; it is 0 for added and deleted rows.
    """
    fields = base.schema.fields
    if len(fields) > MASK_COLUMNS:
        raise ValueError(f"a mask holds {MASK_COLUMNS} columns, the table has {len(fields)}")
    side = lambda df, tag: df.select(canonical_text(df.schema[key]).alias("k"), row_hash(df.schema.fields).alias(f"{tag}_hash"), *[canonical_text(df.schema[f.name]).alias(f"{tag}{i}") for i, f in enumerate(fields)])
    kind = F.when(F.col("base_hash").isNull(), "ADDED").when(F.col("head_hash").isNull(), "DELETED").otherwise("CHANGED")
    both = side(base, "base").join(side(head, "head"), "k", "full_outer").where(~F.col("base_hash").eqNullSafe(F.col("head_hash"))).withColumn("class", kind)
    bits = [F.when(F.col(f"base{i}").eqNullSafe(F.col(f"head{i}")), F.lit(0)).otherwise(F.lit(1 << i)).cast("bigint") for i in range(len(fields))]
    mask = F.when(F.col("class") == "CHANGED", reduce(Column.__add__, bits)).otherwise(F.lit(0)).cast("bigint")
    return both.select(F.col("k").alias("key_value"), "class", mask.alias("cols_mask"), "base_hash", "head_hash")


def keyless_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(added, deleted) of two multisets of rows: a changed row counts as one of each."""
    side = lambda df, n: hashed(df).select("h", F.lit(n).alias("d"))
    per = side(base, -1).unionByName(side(head, 1)).groupBy("h").agg(F.sum("d").alias("d"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("added"), F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("deleted"))


def column_touch(masks: DataFrame, columns: list[str], mask: str = "cols_mask", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, column_name, touched): how many masks have each column's bit set, in one aggregation."""
    sums = [F.coalesce(F.sum(F.shiftright(F.col(mask), i).bitwiseAND(F.lit(1))), F.lit(0)).alias(f"c{i}") for i in range(len(columns))]
    wide = masks.groupBy(*by).agg(*sums) if by else masks.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("touched")) for i, c in enumerate(columns)])
    return wide.select(*by, F.inline(pairs))


def touched_names(mask: Column, columns: list[str]) -> Column:
    """The names of a mask's columns, in column order, joined by commas."""
    return F.concat_ws(",", *[F.when(F.shiftright(mask, i).bitwiseAND(F.lit(1)) == 1, c) for i, c in enumerate(columns)])


def rarity_order(diff: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """The ``limit`` rows to look at first: those that touch the rarest columns, then CHANGED, DELETED, ADDED, then key.

    The counts of the columns are a single row, so they are broadcast.
    """
    sums = [F.sum(F.shiftright("cols_mask", i).bitwiseAND(F.lit(1))).alias(f"c{i}") for i in range(len(columns))]
    counts = diff.agg(*sums)
    own = [F.when(F.shiftright("cols_mask", i).bitwiseAND(F.lit(1)) == 1, F.col(f"c{i}")) for i in range(len(columns))]
    rare = F.coalesce(F.array_min(F.array_compact(F.array(*own))), F.lit(1 << 60))
    rank = F.when(F.col("class") == "CHANGED", 0).when(F.col("class") == "DELETED", 1).otherwise(2)
    rows = diff.crossJoin(F.broadcast(counts)).withColumn("rarity", rare)
    return rows.orderBy("rarity", rank, "key_value").limit(limit).select("key_value", "class", "cols_mask", "rarity")


def drifted_keys(touched: DataFrame, base: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Touched keys (key_value) whose row in ``current`` is no longer the one the branch was opened on."""
    then, now = hashed(base, key).toDF("key_value", "then_hash"), hashed(current, key).toDF("key_value", "now_hash")
    both = touched.select("key_value").join(then, "key_value", "left").join(now, "key_value", "left")
    return both.where(~F.col("then_hash").eqNullSafe(F.col("now_hash"))).select("key_value")


def with_decisions(diff: DataFrame, decisions: DataFrame) -> DataFrame:
    """A fresh diff with ``approved`` and ``default_reason``, human decisions(key_value, approved) carried over."""
    d = decisions.select("key_value", F.col("approved").alias("own"))
    out = diff.join(d, "key_value", "left")
    return out.withColumn("approved", F.coalesce("own", F.lit(True))).withColumn("default_reason", F.when(F.col("own").isNull(), "DEFAULT").otherwise("HUMAN")).drop("own")


def sample_values(diff: DataFrame, base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """The sampled keys with both versions of their row as structs."""
    side = lambda df, n: df.select(canonical_text(df.schema[key]).alias("key_value"), F.struct(*df.columns).alias(n))
    return diff.join(side(base, "before"), "key_value", "left").join(side(head, "after"), "key_value", "left")
