"""Paging, searching, exports, lineage and precedents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.operators.diff import touched_names

PAGE, MAX_PAGE = 50, 500


def matches(df: DataFrame, needle: str) -> Column:
    """Whether any text column holds the needle, whatever its case; % and _ have no meaning in it."""
    cols = [F.upper(F.col(f"`{c}`")).contains(needle.upper()) for c, t in df.dtypes if t == "string"]
    return F.coalesce(reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in cols]), F.lit(False)) if cols else F.lit(False)


def by(*columns: str) -> WindowSpec:
    return Window.partitionBy(*columns)


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values; a value that is None asks nothing."""
    for c, v in wanted.items():
        df = df.where(F.col(f"`{c}`") == v) if v is not None else df
    return df


def page(df: DataFrame, order: str | None = None, descending: bool = False, limit: int = PAGE, offset: int = 0, needle: str | None = None) -> DataFrame:
    """One page of a table; ties of the ordering column are broken by all others, so pages are stable."""
    order = order or df.columns[0]
    if order not in df.columns:
        raise ValueError(f"no column {order}")
    rows = df.where(matches(df, needle)) if needle else df
    first = F.col(f"`{order}`")
    rest = [F.col(f"`{c}`") for c, t in df.dtypes if c != order and not t.startswith(("map",))]
    return rows.orderBy(first.desc() if descending else first.asc(), *rest).offset(max(0, offset)).limit(min(MAX_PAGE, max(1, limit)))


def change_export(diff: DataFrame, base: DataFrame, head: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Decisions of a change-set with the touched columns' names and both versions of chosen columns side by side."""
    before = base.select(F.col(key).cast("string").alias("key_value"), *[F.col(c).alias(f"{c}_before") for c in columns])
    after = head.select(F.col(key).cast("string").alias("key_value"), *[F.col(c).alias(f"{c}_after") for c in columns])
    named = diff.withColumn("touched", touched_names(F.col("cols_mask"), base.columns))
    return named.join(before, "key_value", "left").join(after, "key_value", "left")


def lineage(golden: DataFrame, a: DataFrame, b: DataFrame, pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """(golden_id, kind, reference, detail) of everything a golden row stems from: sources, evidence, changes."""
    refs = lambda c, k: golden.where(F.col(c).isNotNull() & (F.col(c) != "")).select("golden_id", F.lit(k).alias("kind"), F.col(c).alias("reference"))
    more = golden.select("golden_id", F.lit("SOURCE_A_MERGED").alias("kind"), F.explode(F.split(F.coalesce("merged_a_refs", F.lit("")), ",")).alias("reference")).where("reference <> ''")
    sources = refs("source_a_ref", "SOURCE_A").unionByName(refs("source_b_ref", "SOURCE_B")).unionByName(more)
    names = a.select(F.col("cust_id").alias("reference"), F.col("full_name").alias("detail")).unionByName(b.select(F.col("client_ref").alias("reference"), F.concat_ws(" ", "first_name", "last_name").alias("detail"))).dropDuplicates(["reference"])
    own = golden.select("golden_id", F.col("source_a_ref").alias("a_id"), F.col("source_b_ref").alias("b_id")).where("a_id is not null and b_id is not null")
    evidence = pairs.join(own, ["a_id", "b_id"]).select("golden_id", F.lit("EVIDENCE").alias("kind"), F.col("pair_id").cast("string").alias("reference"), F.concat_ws(" ", "panel_result", F.coalesce(F.trim("verdict"), F.lit("?"))).alias("detail"))
    changed = changes.join(golden.select("golden_id"), changes["key_value"] == golden["golden_id"]).select("golden_id", F.lit("CHANGE").alias("kind"), F.col("branch_id").alias("reference"), F.col("class").alias("detail"))
    return sources.join(names, "reference", "left").select("golden_id", "kind", "reference", "detail").unionByName(evidence).unionByName(changed)


def nearest(precedents: DataFrame, context: str, k: int = 3) -> DataFrame:
    """The k precedents(precedent_id, context) that read most like a context; ties go to the newer one."""
    return precedents.withColumn("distance", F.levenshtein("context", F.lit(context))).orderBy("distance", F.desc("precedent_id")).limit(k)


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """(key_column, n, filled, different, is_key) of a column."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("filled"), F.count_distinct(key).alias("different"))
    return n.select(F.lit(key).alias("key_column"), "n", "filled", "different", ((F.col("n") == F.col("filled")) & (F.col("n") == F.col("different"))).alias("is_key"))
