"""Scoring a matching run and the golden table it led to against an answer key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def score(candidates: DataFrame, golden: DataFrame, true_pairs: DataFrame, true_dups: DataFrame) -> DataFrame:
    """One row: how many merged pairs are right, decoys or wrong, what the golden rows join wrongly, and what was missed.

    candidates(kind, a_id, b_id, verdict), golden(source_a_ref, source_b_ref, merged_a_refs), true_pairs(a_id, b_id,
    is_match, is_decoy) and true_dups(a_id, a_dup_id), the last either way round.  Each list is a distributed join; the
    single row is put together from aggregates of one row each.
    """
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    key = true_pairs.groupBy("a_id", "b_id").agg(F.max(F.col("is_match").cast("int")).alias("m"), F.max(F.col("is_decoy").cast("int")).alias("d"))
    dups = true_dups.select(F.least("a_id", "a_dup_id").alias("x"), F.greatest("a_id", "a_dup_id").alias("y")).distinct().withColumn("t", F.lit(1))
    merged = candidates.where("verdict = 'MERGE'").select("kind", "a_id", "b_id").distinct()
    number = lambda c: F.count(F.when(c, 1))
    ab = merged.where("kind = 'AB'").join(key, ["a_id", "b_id"], "left").agg(F.count(F.lit(1)).alias("merged_pairs"), number(F.col("m") == 1).alias("tp"), number(F.col("d") == 1).alias("decoys_merged"))
    aa = merged.where("kind = 'AA'").select(F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y")).distinct().join(dups, ["x", "y"], "left").agg(F.count(F.lit(1)).alias("dups_merged"), F.count("t").alias("dups_tp"))
    flagged = candidates.agg(number(F.col("verdict") == "FLAG").alias("flagged_pairs"))
    true_n = key.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("true_pairs"))
    joined = golden.where(some("source_a_ref") & some("source_b_ref")).select(F.col("source_a_ref").alias("a_id"), F.col("source_b_ref").alias("b_id"))
    wrong = joined.join(key, ["a_id", "b_id"], "left").agg(number(F.coalesce(F.col("m"), F.lit(0)) == 0).alias("false_merges_ab"), number(F.col("d") == 1).alias("decoy_false_merges"), F.count(F.lit(1)).alias("enriched"))
    absorbed = golden.where(some("merged_a_refs")).select("source_a_ref", F.explode(F.split("merged_a_refs", ",")).alias("other")).select(F.least("source_a_ref", F.trim("other")).alias("x"), F.greatest("source_a_ref", F.trim("other")).alias("y"))
    wrong_aa = absorbed.join(dups, ["x", "y"], "left").agg(number(F.col("t").isNull()).alias("false_merges_aa"))
    new = golden.where(~F.coalesce(some("source_a_ref"), F.lit(False)) & some("source_b_ref")).select(F.col("source_b_ref").alias("b_id"))
    missed = new.join(key.where("m = 1").select("b_id").distinct().withColumn("t", F.lit(1)), "b_id", "left").agg(F.count(F.lit(1)).alias("added_as_new"), F.count("t").alias("matches_added_as_new"))
    out = ab
    for one in (aa, flagged, true_n, wrong, wrong_aa, missed):
        out = out.crossJoin(F.broadcast(one))  # single rows
    out = out.withColumn("fp", F.col("merged_pairs") - F.col("tp")).withColumn("fn", F.col("true_pairs") - F.col("tp"))
    p, r = F.coalesce(F.try_divide("tp", "merged_pairs"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "true_pairs"), F.lit(0.0))
    out = out.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4))
    return out
