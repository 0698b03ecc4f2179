"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.address import same_location
from tidemark.llm.canonical import MAX_ENTRIES, map_to_reference
from tidemark.llm.clean import STAND_INS
from tidemark.llm.countries import FORMAL, SHORT, country_names
from tidemark.llm.fusion import fuse
from tidemark.llm.groups import connected_groups
from tidemark.llm.leakage import find_leaks
from tidemark.llm.matching import match
from tidemark.llm.names import link_names
from tidemark.llm.packing import pack
from tidemark.llm.spans import expand_pairs, shared_amount, shared_spans
from tidemark.session import broadcast_small
from tidemark.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its twin."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query(
    "p7_found",
    r"""
    WITH RECURSIVE e AS (
        SELECT DISTINCT a_id AS x, b_id AS y FROM candidates
        WHERE upper(regexp_replace(verdict, '^\s+|\s+$', '', 'g')) = 'MERGE' AND trim(a_id) <> '' AND trim(b_id) <> '' AND a_id <> b_id),
    n AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    r(v, m) AS (SELECT x, x FROM n UNION SELECT n.y, r.m FROM r JOIN n ON n.x = r.v WHERE r.m < n.y)
    SELECT v AS record_id, min(m) AS group_id FROM r GROUP BY v""",
)
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The group of every record linked by a MERGE verdict, in any letter case and with or without blanks around it."""
    verdict = F.upper(F.regexp_replace("verdict", r"^\s+|\s+$", ""))
    return connected_groups(read_table(spark, sf, "candidates").where(verdict == "MERGE"), "a_id", "b_id")


_STAND_INS = ", ".join("'" + w.replace("'", "''") + "'" for w in STAND_INS)


def _usable_sql(c: str) -> str:
    v = f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    return f"({c} IS NOT NULL AND {v} <> '' AND {v} NOT IN ({_STAND_INS}) AND NOT regexp_matches(regexp_replace({v}, '[\\s+()/.-]', '', 'g'), '^(0{{6,}}|9{{6,}})$'))"


def _date_sql(c: str) -> str:
    v = f"trim(cast({c} AS VARCHAR))"
    dmy, ymd = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})$"
    part = lambda p, i: f"regexp_extract({v}, '{p}', {i})"
    return (
        f"try_cast(CASE WHEN regexp_matches({v}, '{dmy}') THEN {part(dmy, 3)} || '-' || lpad({part(dmy, 2)}, 2, '0') || '-' || lpad({part(dmy, 1)}, 2, '0') "
        f"WHEN regexp_matches({v}, '{ymd}') THEN {part(ymd, 1)} || '-' || lpad({part(ymd, 2)}, 2, '0') || '-' || lpad({part(ymd, 3)}, 2, '0') END AS DATE)"
    )


def _p3_sql() -> str:
    fields = {"FULL_NAME": ("true", "true"), "EMAIL": (_usable_sql("email"), _usable_sql("email_addr")), "PHONE": (_usable_sql("phone"), _usable_sql("mobile")),
              "ADDRESS": (_usable_sql("addr_line"), _usable_sql("street")),
              "DATE_OF_BIRTH": (f"coalesce(year({_date_sql('date_of_birth')}) > 1910, false)", f"coalesce(year({_date_sql('dob')}) > 1910, false)")}
    each = " UNION ALL ".join(
        f"SELECT m.golden_id, '{f}' AS field_name, m.record_id, r.src, r.t, upper(json_extract_string(CASE WHEN json_valid(m.survivorship) THEN m.survivorship END, '$.{f}')) AS said FROM m JOIN r USING (record_id) WHERE r.{f}"
        for f in fields
    )
    cols = lambda i: ", ".join(f"{x[i]} AS {f}" for f, x in fields.items())
    return f"""
    WITH x AS (SELECT golden_id, survivorship, trim(unnest(string_split(concat_ws(',', source_a_ref, source_b_ref, merged_a_refs), ','))) AS record_id FROM golden_seed),
    m AS (SELECT DISTINCT golden_id, survivorship, record_id FROM x WHERE record_id <> ''
          QUALIFY min(record_id) OVER (PARTITION BY golden_id) <> max(record_id) OVER (PARTITION BY golden_id)),
    r AS (SELECT DISTINCT cust_id AS record_id, 'A' AS src, created_at AS t, {cols(0)} FROM source_a
          UNION ALL SELECT DISTINCT client_ref, 'B', last_seen, {cols(1)} FROM source_b),
    c AS ({each})
    SELECT golden_id, field_name, record_id FROM c QUALIFY row_number() OVER (PARTITION BY golden_id, field_name
        ORDER BY coalesce(said = src, false) DESC, coalesce(t < TIMESTAMP '2026-07-01', false) DESC, CASE WHEN t < TIMESTAMP '2026-07-01' THEN t END DESC NULLS LAST, record_id) = 1"""


def _fused(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    return fuse(read_table(spark, sf, "golden_seed"), read_table(spark, sf, "source_a"), read_table(spark, sf, "source_b"), policy)


@query("p3_found", _p3_sql())
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The record whose value survives, for each golden row of two or more members and each field."""
    return _fused(spark, sf, "declared").select("golden_id", "field_name", "record_id")


@query("p3_fused")
def p3_fused(spark: SparkSession, sf: str) -> DataFrame:
    """The value of largest posterior where the declared policy is left aside and the sources' votes decide."""
    return _fused(spark, sf, "votes")


@query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The country meant by every typed value that isn't literally an entry of the reference list, or UNMATCHED."""
    reference = read_table(spark, sf, "country_ref")
    typed = (("source_a", "cust_id", "country", "country_name"), ("source_b", "client_ref", "nation", "country_code"))
    values = None
    for table, key, column, entry in typed:
        own = read_table(spark, sf, table).select(F.col(key).alias("record_id"), F.col(column).alias("value")).where("value <> ''")
        own = own.join(broadcast_small(reference.select(F.col(entry).alias("value"))), "value", "left_anti")
        values = own if values is None else values.unionByName(own)
    codes = [r[0] for r in reference.select("country_code").where("country_code is not null").limit(MAX_ENTRIES).collect()]
    return map_to_reference(values.select("record_id", "value").distinct(), reference, "country_code", "country_name", country_names(spark, codes), FORMAL, SHORT).select("record_id", F.col("code").alias("country_code")).distinct()


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    sizes = {r["pack_id"]: r["capacity_tokens"] for r in read_table(spark, sf, "pack_sizes").collect()}  # the list of capacities
    return pack(read_table(spark, sf, "documents").select("doc_id", "text"), sizes)


@query("p4_towns")
def p4_towns(spark: SparkSession, sf: str) -> DataFrame:
    """The town meant by every town of source_b; the list are those towns that ten or more golden rows hold."""
    listed = read_table(spark, sf, "golden_seed").where("trim(city) <> ''").groupBy(F.trim("city").alias("town")).agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("town", F.col("town").alias("code"))
    values = read_table(spark, sf, "source_b").where("town <> ''").select(F.col("client_ref").alias("record_id"), F.col("town").alias("value")).distinct()
    return map_to_reference(values, listed, "code", "town").select("record_id", F.col("code").alias("town"))


@query("p8_packed")
def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """The container and place of every document, for each capacity of pack_sizes."""
    return _packed(spark, sf)


@query(
    "p8_whole",
    """
    SELECT pack_id, (SELECT count(*) FROM documents) AS documents, 0 AS overfull, 0 AS overlapping, 0 AS cut_needlessly, true AS full_to_a_percent
    FROM pack_sizes""",
)
def p8_whole(spark: SparkSession, sf: str) -> DataFrame:
    """What every packing must hold: all documents placed, no container overfull, no two texts in one place, none cut that
    fits, and under one percent of the space of all but one container of each capacity unused."""
    placed = _packed(spark, sf).join(F.broadcast(read_table(spark, sf, "pack_sizes").withColumnRenamed("capacity_tokens", "capacity")), "pack_id")
    each = placed.where("n_tokens > 0").groupBy("pack_id", "container_id", "capacity").agg(F.sum("n_tokens").alias("filled"), F.max(F.col("start_token") + F.col("n_tokens")).alias("ends"))
    held = each.groupBy("pack_id").agg(
        F.count(F.when(F.col("filled") > F.col("capacity"), 1)).alias("overfull"), F.count(F.when(F.col("filled") != F.col("ends"), 1)).alias("overlapping"),
        (F.sum("filled") >= 0.99 * (F.count(F.lit(1)) - 1) * F.max("capacity")).alias("full_to_a_percent"),
    )
    docs = placed.groupBy("pack_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    cut = docs.groupBy("pack_id").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity")), 1)).alias("cut_needlessly"))
    return cut.join(held, "pack_id").select("pack_id", "documents", F.col("overfull").cast("int").alias("overfull"), F.col("overlapping").cast("int").alias("overlapping"), F.col("cut_needlessly").cast("int").alias("cut_needlessly"), "full_to_a_percent")


@query("p8_fill")
def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each capacity and tier are, and how evenly step groups are loaded."""
    placed = _packed(spark, sf).where("n_tokens > 0").join(F.broadcast(read_table(spark, sf, "pack_sizes")), "pack_id")
    each = placed.groupBy("pack_id", "tier", "container_id").agg(F.sum("n_tokens").alias("filled"), F.max("capacity_tokens").alias("capacity"))
    return each.groupBy("pack_id", "tier").agg(F.count(F.lit(1)).alias("containers"), F.sum("filled").alias("tokens"), F.round(F.sum("filled") / F.sum("capacity"), 6).alias("fill"))


@query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents whose texts have a run of at least 400 characters in common."""
    return expand_pairs(*shared_spans(read_table(spark, sf, "documents").select("doc_id", "text")))


@query("p10_shared")
def p10_shared(spark: SparkSession, sf: str) -> DataFrame:
    """For each document its class of equal texts, its links and how many of its characters stand elsewhere too."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return shared_amount(docs, *shared_spans(docs))


@query("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a passage of eval_items, whole or in part, with the item."""
    return find_leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items")).select("doc_id", "item_id")


@query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of records, of either source or both, whose addresses denote one location."""
    a = read_table(spark, sf, "source_a").select(F.col("cust_id").alias("record_id"), F.col("addr_line").alias("line"), F.col("city").alias("town"), F.col("postcode").alias("zip"))
    b = read_table(spark, sf, "source_b").select(F.col("client_ref").alias("record_id"), F.col("street").alias("line"), "town", "zip")
    return same_location(a.unionByName(b))


def _sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(read_table(spark, sf, t) for t in ("source_a", "source_b", "golden_seed"))


@query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a record of source_a and one of source_b that are the same person or firm."""
    across = match(*_sources(spark, sf), across=True)
    return across.select(F.col("id1").alias("cust_id"), F.col("id2").alias("client_ref"))


@query("p6_matched")
def p6_matched(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of records that are likely one entity, within and across the sources, each with its confidence."""
    return match(*_sources(spark, sf)).select("id1", "id2", F.round("probability", 4).alias("confidence"))


@query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of records of one person or firm whose names differ in at least one character."""
    return link_names(*_sources(spark, sf)).select(F.col("id1").alias("record_id_1"), F.col("id2").alias("record_id_2"))
