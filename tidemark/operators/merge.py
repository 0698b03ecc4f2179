"""Staging approved rows, and what the table's fingerprint must be afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.hashing import canonical_text, fingerprint_sums


def stage(current: DataFrame, head: DataFrame, diff: DataFrame, key: str) -> DataFrame:
    """The table with the approved rows of diff(key_value, class, approved) applied.

    Approved added and changed rows come from ``head``; refused rows keep their current state; all other rows are
    untouched.  An approved deletion and a refused addition are in neither part.
    """
    k = lambda df: canonical_text(df.schema[key])
    marks = diff.select(F.col("key_value").alias("__k"), "class", "approved")
    taken = head.withColumn("__k", k(head)).join(marks.where("approved and class <> 'DELETED'").select("__k"), "__k", "left_semi").drop("__k")
    now = current.withColumn("__k", k(current)).join(marks, "__k", "left").where("class is null or not approved").drop("__k", "class", "approved")
    return taken.unionByName(now)


def expected_fingerprint(pre: DataFrame, diff: DataFrame) -> DataFrame:
    """(n, s1, s2) that the staged table must have, from pre(n, s1, s2) and the hashes of the approved rows alone."""
    ok = diff.where("approved")
    minus = ok.where("class <> 'ADDED'").agg(*fingerprint_sums("base_hash")).toDF("mn", "m1", "m2")
    plus = ok.where("class <> 'DELETED'").agg(*fingerprint_sums("head_hash")).toDF("pn", "p1", "p2")
    one = pre.crossJoin(F.broadcast(minus)).crossJoin(F.broadcast(plus))
    return one.select((F.col("n") - F.col("mn") + F.col("pn")).alias("n"), *[(F.col(f"s{i}") - F.col(f"m{i}") + F.col(f"p{i}")).cast("decimal(38,0)").alias(f"s{i}") for i in (1, 2)])


def later_merges(ledger: DataFrame, merge_id: int, table: str) -> DataFrame:
    """Merges applied to ``table`` after a given one and not undone: only the last application may be undone.

    ledger(merge_id, tables, resolved_at, unmerged_at), ``tables`` a comma list; order is that of application, then id.
    """
    here = ledger.where(F.array_contains(F.split("tables", ","), table))
    me = F.broadcast(here.where(F.col("merge_id") == merge_id).select(F.col("resolved_at").alias("mine")).limit(1))
    after = (F.col("resolved_at") > F.col("mine")) | ((F.col("resolved_at") == F.col("mine")) & (F.col("merge_id") > merge_id))
    return here.crossJoin(me).where(after & F.col("unmerged_at").isNull()).drop("mine")
