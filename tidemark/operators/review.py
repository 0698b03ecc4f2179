"""What reviewers see and say: order of cards, filters, closed pairs, precedents, the state of the system."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.browse import matches


def review_order(cards: DataFrame) -> DataFrame:
    """cards(key_value, class, panel_result, component_size, approved) with the ones to look at first on top."""
    rank = F.when(F.col("panel_result") == "SPLIT", 0).when(F.col("component_size") > 2, 1).when(F.col("class") == "DELETED", 2).when(~F.col("approved"), 3).otherwise(4)
    return cards.withColumn("review_rank", rank).orderBy("review_rank", "key_value")


def filter_cards(cards: DataFrame, needle: str = "", show: str = "all", sort: str = "risk") -> DataFrame:
    """Cards that hold the needle and are of the shown kind, by rank of risk or by score."""
    kinds = {"all": F.lit(True), "review": ~F.col("approved") | (F.col("panel_result") == "SPLIT"), "accepted": F.col("approved"), "rejected": ~F.col("approved"), "split": F.col("panel_result") == "SPLIT"}
    rows = cards.where(kinds[show]).where(matches(cards, needle)) if needle else cards.where(kinds[show])
    order = {"risk": [F.col("review_rank"), F.col("key_value")], "score_asc": [F.col("score_total").asc(), F.col("key_value")], "score_desc": [F.col("score_total").desc(), F.col("key_value")]}[sort]
    return review_order(rows).orderBy(*order)


def closed_keys(keys: DataFrame, dedup: DataFrame) -> DataFrame:
    """The keys and, of each pair that keeps one row and drops another, the partner: both are decided together."""
    x = keys.join(dedup, keys["key_value"] == dedup["keep_golden_id"]).select(F.col("drop_golden_id").alias("key_value"))
    y = keys.join(dedup, keys["key_value"] == dedup["drop_golden_id"]).select(F.col("keep_golden_id").alias("key_value"))
    return reduce(DataFrame.unionByName, [keys.select("key_value"), x, y]).distinct()


def standing_precedents(log: DataFrame) -> DataFrame:
    """Precedents of an append-only log(precedent_id, action, context, verdict, note, at): the last word on each, without
    the deleted ones, with how often each was cited."""
    w = W.partitionBy("precedent_id").orderBy(F.col("at").desc())
    said = log.where("action <> 'CITE'").withColumn("__n", F.row_number().over(w)).where("__n = 1 and action <> 'DELETE'").drop("__n", "action")
    first = log.where("action = 'RECORD'").groupBy("precedent_id").agg(F.min_by("context", "at").alias("context"), F.min_by("verdict", "at").alias("verdict"))
    cited = log.where("action = 'CITE'").groupBy("precedent_id").agg(F.count(F.lit(1)).alias("times_cited"))
    return said.select("precedent_id", "note").join(first, "precedent_id").join(cited, "precedent_id", "left").withColumn("times_cited", F.coalesce("times_cited", F.lit(0)))


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns, signature) of every table."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("column_names"))
    return reduce(DataFrame.unionByName, [one(n, df) for n, df in sorted(tables.items())])
