"""Queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.hashing import fingerprint_sums, hashed, row_hash
from tidemark.operators import browse, diff, gate, linkage, merge, review
from tidemark.operators.checksum_diff import checksum_diff
from tidemark.plans import dml, playbook
from tidemark.sources import delimited, synthetic
from tidemark.session import scratch
from tidemark.sources.tables import read_table
from tidemark.streaming import events as ev

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


GOLDEN = (
    "golden_id full_name email phone addr_line city postcode country date_of_birth source_a_ref source_b_ref "
    "merged_a_refs merged_at survivorship"
).split()

_CANON = {c: f"coalesce({c}, '')" for c in GOLDEN} | {
    "date_of_birth": "coalesce(cast(date_of_birth AS VARCHAR), '')",
    "merged_at": "coalesce(strftime(merged_at, '%Y-%m-%d %H:%M:%S.%g'), '')",
}


@query(
    "p5_found",
    "WITH "
    + ", ".join(f"{t} AS (SELECT DISTINCT {', '.join(f'{x} AS {c}' for c, x in _CANON.items())} FROM {src})" for t, src in (("l", "golden_seed"), ("r", "branch_customers")))
    + ", d AS (SELECT coalesce(l.golden_id, r.golden_id) AS key_value, "
    "CASE WHEN l.golden_id IS NULL THEN 'ADDED' WHEN r.golden_id IS NULL THEN 'DELETED' ELSE 'CHANGED' END AS class, "
    "CASE WHEN l.golden_id IS NULL OR r.golden_id IS NULL THEN 16383 ELSE "
    + " + ".join(f"(CASE WHEN l.{c} <> r.{c} THEN {1 << i} ELSE 0 END)" for i, c in enumerate(GOLDEN) if i)
    + " END AS cols_mask FROM l FULL OUTER JOIN r ON l.golden_id = r.golden_id) "
    "SELECT key_value, class, cast(cols_mask AS BIGINT) AS cols_mask FROM d WHERE cols_mask <> 0",
)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of golden_seed and branch_customers that are missing on one side or differ."""
    return checksum_diff(read_table(spark, sf, "golden_seed"), read_table(spark, sf, "branch_customers"), "golden_id", GOLDEN)


# ---- a branch of customer: one column changed on every seventh key, every 97th row removed, rows of supplier added

_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _branch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    base = read_table(spark, sf, "customer").select(*_COLS)
    bumped = F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    head = base.where("c_custkey % 97 <> 0").withColumn("c_acctbal", bumped)
    new = read_table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return base, head.unionByName(new)


def _part(v: str) -> str:
    return f"coalesce(cast(length({v}) AS VARCHAR) || ':' || {v}, ':')"


_TEXT = {"c_custkey": "cast(c_custkey AS VARCHAR)", "c_name": "nullif(c_name, '')", "c_nationkey": "cast(c_nationkey AS VARCHAR)", "c_acctbal": "CASE WHEN cast(try_cast(c_acctbal AS DECIMAL(38,6)) AS DOUBLE) = c_acctbal THEN cast(try_cast(c_acctbal AS DECIMAL(38,6)) AS VARCHAR) ELSE cast(c_acctbal AS VARCHAR) END", "c_mktsegment": "nullif(c_mktsegment, '')"}
_HASH = "sha256(" + " || '|' || ".join(_part(v) for v in _TEXT.values()) + ")"
_SLICES = "count(h) AS n, coalesce(sum(('0x' || substr(h, 1, 15))::UBIGINT::HUGEINT), 0) AS s1, coalesce(sum(('0x' || substr(h, 16, 15))::UBIGINT::HUGEINT), 0) AS s2"
_BRANCH_SQL = f"""
    base AS (SELECT {', '.join(_COLS)} FROM customer),
    head AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 97 <> 0
             UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal, NULL FROM supplier),
    b AS (SELECT {_TEXT['c_custkey']} AS k, {_HASH} AS h, * FROM base), h AS (SELECT {_TEXT['c_custkey']} AS k, {_HASH} AS h, * FROM head),
    d AS (SELECT coalesce(b.k, h.k) AS key_value, CASE WHEN b.k IS NULL THEN 'ADDED' WHEN h.k IS NULL THEN 'DELETED' ELSE 'CHANGED' END AS class,
          CASE WHEN b.k IS NULL OR h.k IS NULL THEN 0 ELSE {' + '.join(f"(CASE WHEN b.{c} IS DISTINCT FROM h.{c} THEN {1 << i} ELSE 0 END)" for i, c in enumerate(_COLS))} END AS cols_mask,
          b.h AS base_hash, h.h AS head_hash FROM b FULL OUTER JOIN h ON b.k = h.k WHERE b.h IS DISTINCT FROM h.h)"""


@query("diff_keyed_rows", f"WITH {_BRANCH_SQL} SELECT key_value, class, cast(cols_mask AS BIGINT) AS cols_mask, base_hash, head_hash FROM d")
def diff_keyed_rows(spark, sf):
    """Every added, changed and deleted row of the branch with its column mask and hashes."""
    return diff.keyed_diff(*_branch(spark, sf), "c_custkey")


@query("diff_keyed_counts", f"WITH {_BRANCH_SQL} SELECT class, count(*) AS n FROM d GROUP BY class")
def diff_keyed_counts(spark, sf):
    return diff_keyed_rows(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("diff_column_touch", f"WITH {_BRANCH_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, coalesce(sum((cols_mask >> {i}) & 1), 0) AS touched FROM d" for i, c in enumerate(_COLS)))
def diff_column_touch(spark, sf):
    return diff.column_touch(diff_keyed_rows(spark, sf), _COLS)


@query(
    "diff_keyless_lineitem",
    "WITH h AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 11 = 0 THEN l_extendedprice + 1 ELSE l_extendedprice END AS l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem WHERE l_orderkey % 13 <> 0) "
    "SELECT (SELECT count(*) FROM (SELECT * FROM h EXCEPT ALL SELECT * FROM lineitem)) AS added, (SELECT count(*) FROM (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM h)) AS deleted",
)
def diff_keyless_lineitem(spark, sf):
    """A table without key: multisets of row hashes."""
    base = read_table(spark, sf, "lineitem")
    head = base.where("l_orderkey % 13 <> 0").withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 11 == 0, F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice")))
    return diff.keyless_diff(base, head)


@query("diff_rarity", f"""WITH {_BRANCH_SQL}, c AS (SELECT {', '.join(f'sum((cols_mask >> {i}) & 1) AS c{i}' for i in range(5))} FROM d),
    r AS (SELECT d.*, coalesce(least({', '.join(f'CASE WHEN (cols_mask >> {i}) & 1 = 1 THEN c{i} END' for i in range(5))}), 1152921504606846976) AS rarity FROM d, c)
    SELECT key_value, class, cast(cols_mask AS BIGINT) AS cols_mask, cast(rarity AS BIGINT) AS rarity FROM r ORDER BY rarity, CASE class WHEN 'CHANGED' THEN 0 WHEN 'DELETED' THEN 1 ELSE 2 END, key_value LIMIT 400""")
def diff_rarity(spark, sf):
    """The 400 cards a reviewer sees first."""
    return diff.rarity_order(diff_keyed_rows(spark, sf), _COLS, 400)


@query("row_hash", f"SELECT c_custkey, {_HASH} AS h FROM customer")
def q_row_hash(spark, sf):
    df = read_table(spark, sf, "customer").select(*_COLS)
    return df.select("c_custkey", row_hash(df.schema.fields).alias("h"))


@query("fingerprint", f"WITH x AS (SELECT {_HASH} AS h FROM customer) SELECT n, cast(s1 AS VARCHAR) AS s1, cast(s2 AS VARCHAR) AS s2 FROM (SELECT {_SLICES} FROM x)")
def q_fingerprint(spark, sf):
    return _shown(hashed(read_table(spark, sf, "customer").select(*_COLS)).agg(*fingerprint_sums("h")))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("n", F.col("s1").cast("string").alias("s1"), F.col("s2").cast("string").alias("s2"))


@query("fingerprint_algebra", f"WITH {_BRANCH_SQL}, x AS (SELECT h FROM h) SELECT n, cast(s1 AS VARCHAR) AS s1, cast(s2 AS VARCHAR) AS s2 FROM (SELECT {_SLICES} FROM x)")
def fingerprint_algebra(spark, sf):
    """The head's fingerprint from the base's and the changed rows' hashes alone."""
    base, head = _branch(spark, sf)
    d = diff.keyed_diff(base, head, "c_custkey").withColumn("approved", F.lit(True))
    return _shown(merge.expected_fingerprint(hashed(base).agg(*fingerprint_sums("h")), d))


@query("drift_keys", f"WITH {_BRANCH_SQL} SELECT key_value FROM d WHERE class <> 'ADDED' AND cast(key_value AS BIGINT) % 3 = 0")
def drift_keys(spark, sf):
    """Touched keys whose row in production has changed since the branch was opened."""
    base, head = _branch(spark, sf)
    now = base.withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    return diff.drifted_keys(diff.keyed_diff(base, head, "c_custkey"), base, now, "c_custkey")


_REFUSED = "cast(key_value AS BIGINT) % 5 = 0"
_STAGED = f"""SELECT {', '.join(f'h.{c}' for c in _COLS)} FROM h JOIN d ON d.key_value = h.k WHERE class <> 'DELETED' AND NOT ({_REFUSED})
    UNION ALL SELECT {', '.join(f'b.{c}' for c in _COLS)} FROM b LEFT JOIN d ON d.key_value = b.k WHERE class IS NULL OR ({_REFUSED})"""


@query("stage_merge", f"WITH {_BRANCH_SQL} {_STAGED}")
def stage_merge(spark, sf):
    """The table after the approved rows are applied; every fifth key was refused."""
    base, head = _branch(spark, sf)
    d = diff.keyed_diff(base, head, "c_custkey").withColumn("approved", F.expr("cast(key_value as bigint) % 5 <> 0"))
    return merge.stage(base, head, d, "c_custkey")


@query("stage_fingerprint", f"WITH {_BRANCH_SQL}, x AS (SELECT {_HASH} AS h FROM ({_STAGED})) SELECT n, cast(s1 AS VARCHAR) AS s1, cast(s2 AS VARCHAR) AS s2 FROM (SELECT {_SLICES} FROM x)")
def stage_fingerprint(spark, sf):
    """What the staged table's fingerprint must be, computed without reading it."""
    base, head = _branch(spark, sf)
    d = diff.keyed_diff(base, head, "c_custkey").withColumn("approved", F.expr("cast(key_value as bigint) % 5 <> 0"))
    return _shown(merge.expected_fingerprint(hashed(base).agg(*fingerprint_sums("h")), d))


def _dml(spark: SparkSession, sf: str, sql: str, kind: str) -> DataFrame:
    for t in ("customer", "supplier"):
        read_table(spark, sf, t).createOrReplaceTempView(f"q__{t}")
    columns = spark.table("q__customer").columns
    return dml.next_state(spark, sql, kind, columns)[1]


@query("dml_update", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def dml_update(spark, sf):
    return _dml(spark, sf, "UPDATE q__customer SET c_acctbal = c_acctbal * 2 WHERE c_nationkey IN (SELECT s_nationkey FROM q__supplier WHERE s_acctbal < 0)", "UPDATE").select(*_COLS)


@query("dml_delete_in_subquery", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE NOT coalesce(c_custkey IN (SELECT s_suppkey FROM supplier), false)")
def dml_delete_in_subquery(spark, sf):
    return _dml(spark, sf, "DELETE FROM q__customer WHERE c_custkey IN (SELECT s_suppkey FROM q__supplier)", "DELETE").select(*_COLS)


@query("dml_insert", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, NULL, s_acctbal, NULL FROM supplier")
def dml_insert(spark, sf):
    return _dml(spark, sf, "INSERT INTO q__customer (c_custkey, c_name, c_acctbal) SELECT s_suppkey + 1000000, s_name, s_acctbal FROM q__supplier", "INSERT").select(*_COLS)


@query("dml_merge", """SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS c_name, c_nationkey, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE c_acctbal + s_acctbal END AS c_acctbal, c_mktsegment
    FROM customer LEFT JOIN (SELECT s_suppkey * 20 AS s_suppkey, s_name, s_acctbal FROM supplier) ON c_custkey = s_suppkey
    UNION ALL SELECT s_suppkey * 20, s_name, s_nationkey, s_acctbal, 'NEW' FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)""")
def dml_merge(spark, sf):
    sql = """MERGE INTO q__customer c USING (SELECT s_suppkey * 20 AS sk, s_name, s_nationkey, s_acctbal FROM q__supplier) s ON c.c_custkey = s.sk
        WHEN MATCHED THEN UPDATE SET c_name = s.s_name, c_acctbal = c.c_acctbal + s.s_acctbal
        WHEN NOT MATCHED THEN INSERT (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) VALUES (s.sk, s.s_name, s.s_nationkey, s.s_acctbal, 'NEW')"""
    return _dml(spark, sf, sql, "MERGE").select(*_COLS)


_FACTS = "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') * 9000 AS added, count(*) FILTER (o_orderstatus = 'F') AS changed, count(*) FILTER (o_orderpriority = '1-URGENT') AS deleted, 50 + (o_custkey % 7) * 1000 AS table_rows, CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS needs_review, CASE WHEN o_custkey % 31 = 0 THEN 'BASE_DRIFT' ELSE '' END AS hard_blocks, (o_custkey % 11) / 10.0 AS confidence FROM orders GROUP BY o_custkey"


@query("gate_decisions", f"""WITH f AS ({_FACTS}), g AS (SELECT *, added + changed + deleted AS total, 100.0 * deleted / table_rows AS pct,
        (added + changed + deleted) * (1.0 - least(1.0, greatest(0.0, confidence))) * (CASE WHEN deleted > 0 THEN 1.0 WHEN changed > 0 THEN 0.7 WHEN added > 0 THEN 0.2 ELSE 0 END) AS risk FROM f)
    SELECT o_custkey, total, round(cast(risk AS DOUBLE), 4) AS risk,
      CASE WHEN hard_blocks <> '' OR pct > 5 THEN 'BLOCKED' WHEN total > 30000 OR pct > 1 OR confidence < 0.2 OR risk > 200 OR needs_review > 0 THEN 'PENDING' ELSE 'MERGE' END AS decision,
      CASE WHEN hard_blocks <> '' AND pct > 5 THEN hard_blocks || ',DELETE_PCT_EXCEEDED' WHEN hard_blocks <> '' THEN hard_blocks WHEN pct > 5 THEN 'DELETE_PCT_EXCEEDED' WHEN total > 30000 THEN 'TOO_MANY_ROWS' WHEN pct > 1 THEN 'DELETE_PCT'
           WHEN confidence < 0.2 THEN 'BELOW_MIN_CONFIDENCE' WHEN risk > 200 THEN 'RISK' WHEN needs_review > 0 THEN 'ROWS_NEED_REVIEW' ELSE 'WITHIN_TIER' END AS reason FROM g""")
def gate_decisions(spark, sf):
    """The decision ladder over many change-sets at once."""
    c = lambda x: F.count(F.when(x, 1))
    f = read_table(spark, sf, "orders").groupBy("o_custkey").agg((c(F.col("o_orderstatus") == "O") * 9000).alias("added"), c(F.col("o_orderstatus") == "F").alias("changed"), c(F.col("o_orderpriority") == "1-URGENT").alias("deleted"))
    f = f.withColumns({"table_rows": 50 + (F.col("o_custkey") % 7) * 1000, "needs_review": F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(0), "hard_blocks": F.when(F.col("o_custkey") % 31 == 0, "BASE_DRIFT").otherwise(""), "confidence": (F.col("o_custkey") % 11).cast("double") / 10.0})
    return gate.decide(f, gate.TIERS[2], min_confidence=0.2).select("o_custkey", "total", F.round("risk", 4).alias("risk"), "decision", "reason")


@query("unmerge_lifo", "WITH l AS (SELECT o_orderkey AS merge_id, o_custkey % 10 AS t, o_orderdate AS resolved_at, o_orderstatus FROM orders), m AS (SELECT * FROM l WHERE merge_id = 100) SELECT l.merge_id FROM l, m WHERE l.t = m.t AND l.o_orderstatus <> 'F' AND (l.resolved_at > m.resolved_at OR (l.resolved_at = m.resolved_at AND l.merge_id > 100))")
def unmerge_lifo(spark, sf):
    """What stands in the way of undoing merge 100: later merges of its table that are not undone."""
    o = read_table(spark, sf, "orders")
    ledger = o.select(F.col("o_orderkey").alias("merge_id"), F.concat(F.lit("T"), (F.col("o_custkey") % 10).cast("string")).alias("tables"), F.col("o_orderdate").alias("resolved_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("unmerged_at"))
    table = ledger.where("merge_id = 100").select("tables").limit(1).collect()
    return merge.later_merges(ledger, 100, table[0][0] if table else "T0").select("merge_id")


@query("key_uniqueness", " UNION ALL ".join(f"SELECT '{k}' AS key_column, count(*) AS n, count({k}) AS filled, count(DISTINCT {k}) AS different, count(*) = count({k}) AND count(*) = count(DISTINCT {k}) AS is_key FROM {t}" for t, k in (("customer", "c_custkey"), ("lineitem", "l_orderkey"), ("branch_customers", "golden_id"))))
def key_uniqueness(spark, sf):
    """Whether a registered key identifies rows, or its table must be treated as keyless."""
    return reduce(DataFrame.unionByName, [browse.uniqueness(read_table(spark, sf, t), k) for t, k in (("customer", "c_custkey"), ("lineitem", "l_orderkey"), ("branch_customers", "golden_id"))])


# ---- linkage of source_a and source_b


def _linked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a = read_table(spark, sf, "source_a").select(F.col("cust_id").alias("id"), "full_name", *[linkage.present(F.col(c)).alias(c) for c in ("email", "phone", "addr_line")], "city", "postcode", F.col("date_of_birth").alias("dob")).distinct()
    b = read_table(spark, sf, "source_b")
    dob = F.to_date(F.try_to_timestamp(F.when(F.col("dob").rlike(r"^\d{2}/\d{2}/\d{4}$"), F.col("dob")), F.lit("dd/MM/yyyy")))
    name = F.concat_ws(" ", F.nullif(F.col("first_name"), F.lit("")), F.nullif(F.col("last_name"), F.lit("")))
    b = b.select(F.col("client_ref").alias("id"), name.alias("full_name"), *[linkage.present(F.col(c)).alias(n) for c, n in (("email_addr", "email"), ("mobile", "phone"), ("street", "addr_line"))], F.col("town").alias("city"), F.col("zip").alias("postcode"), dob.alias("dob")).distinct()
    return linkage.normalise(a), linkage.normalise(b)


def _present_sql(c: str) -> str:
    return f"CASE WHEN trim({c}) <> '' AND lower(trim({c})) NOT IN ('-', '--', '---', '.', '?', 'x', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'unknown', 'tbc', 'tbd', 'declined', 'ex-directory') AND NOT regexp_matches(regexp_replace(trim({c}), '[ ()+./-]', '', 'g'), '^(0{{6,}}|9{{6,}})$') THEN trim({c}) END"


def _norm_sql(raw: str) -> str:
    fold = lambda c: f"translate(replace({c}, 'ß', 'ss'), '{linkage.MARKED}', '{linkage.PLAIN}')"
    digits = "regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')"
    return f"""(SELECT id, name_n, name_base, nullif(regexp_extract(name_base, '^([^ ]+)', 1), '') AS given_n, nullif(regexp_extract(name_base, '([^ ]+)$', 1), '') AS family_n, nullif(regexp_extract(name_n, ' (JR|SR|JNR|SNR|II|III)$', 1), '') AS suffix,
        CASE WHEN regexp_matches(name_n, '{linkage.BUSINESS}') THEN 1 ELSE 0 END AS is_business, nullif(lower(trim(email)), '') AS email_n, nullif(regexp_extract(lower(trim(email)), '^([^@]+)@', 1), '') AS email_local, nullif(regexp_extract(lower(trim(email)), '@([^@]+)$', 1), '') AS email_domain,
        nullif(right({digits}, 10), '') AS phone_n, nullif(right({digits}, 7), '') AS phone7, nullif(upper(replace(postcode, ' ', '')), '') AS postcode_n, nullif(upper(regexp_replace({fold('addr_line')}, '[^\\p{{L}}0-9]', '', 'g')), '') AS street_n, nullif(upper(trim({fold('city')})), '') AS city_n, dob
      FROM (SELECT *, nullif(regexp_replace(regexp_replace(name_n, '{linkage.BUSINESS}', ''), '{linkage.SUFFIX}', ''), '') AS name_base FROM (SELECT *, nullif(upper(trim(regexp_replace({fold('full_name')}, '[^\\p{{L}} '']', '', 'g'))), '') AS name_n FROM ({raw}))))"""


_A_RAW = f"SELECT DISTINCT cust_id AS id, full_name, {_present_sql('email')} AS email, {_present_sql('phone')} AS phone, {_present_sql('addr_line')} AS addr_line, city, postcode, date_of_birth AS dob FROM source_a"
_B_RAW = f"SELECT DISTINCT client_ref AS id, concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')) AS full_name, {_present_sql('email_addr')} AS email, {_present_sql('mobile')} AS phone, {_present_sql('street')} AS addr_line, town AS city, zip AS postcode, try_cast(CASE WHEN regexp_matches(dob, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') THEN substr(dob, 7) || '-' || substr(dob, 4, 2) || '-' || substr(dob, 1, 2) END AS DATE) AS dob FROM source_b"
_LINK_SQL = f"na AS {_norm_sql(_A_RAW)}, nb AS {_norm_sql(_B_RAW)}"
_NAME_COLS, _CONTACT_COLS = ["id", "name_n", "name_base", "given_n", "family_n", "suffix", "is_business"], ["id", "email_n", "email_local", "email_domain", "phone_n", "phone7", "postcode_n", "street_n", "city_n", "dob"]


@query("normalise_names", f"WITH {_LINK_SQL} SELECT {', '.join(_NAME_COLS)} FROM na UNION ALL SELECT {', '.join(_NAME_COLS)} FROM nb")
def normalise_names(spark, sf):
    a, b = _linked(spark, sf)
    return a.select(*_NAME_COLS).unionByName(b.select(*_NAME_COLS))


@query("normalise_contact", f"WITH {_LINK_SQL} SELECT {', '.join(_CONTACT_COLS)} FROM na UNION ALL SELECT {', '.join(_CONTACT_COLS)} FROM nb")
def normalise_contact(spark, sf):
    a, b = _linked(spark, sf)
    columns = [*_CONTACT_COLS[:-1], F.col("dob").cast("string").alias("dob")]
    return a.select(*columns).unionByName(b.select(*columns))




def _soundex_sql(c: str) -> str:
    """American Soundex as the engine's function defines it: H and W are passed over, other signs without code divide."""
    first, rest = f"substr({c}, 1, 1)", f"regexp_replace(substr({c}, 2), '[HW]', '', 'g')"
    codes = f"translate({first} || {rest}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000077')"
    runs = f"regexp_replace({codes}, '[^0-7]', '0', 'g')"
    for d in "01234567":
        runs = f"regexp_replace({runs}, '{d}+', '{d}', 'g')"
    return f"(CASE WHEN {c} IS NULL THEN NULL WHEN NOT regexp_matches({c}, '^[A-Z]') THEN {c} ELSE {first} || rpad(substr(replace(substr({runs}, 2), '0', ''), 1, 3), 3, '0') END)"


_RULES_SQL = {
    "SOUNDEX_CITY": f"SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM (SELECT *, {_soundex_sql('family_n')} AS sx FROM na) a JOIN (SELECT *, {_soundex_sql('family_n')} AS sx FROM nb) b ON a.city_n = b.city_n AND a.sx = b.sx",
    "DOB_SOUNDEX": f"SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM (SELECT *, {_soundex_sql('family_n')} AS sx FROM na) a JOIN (SELECT *, {_soundex_sql('family_n')} AS sx FROM nb) b ON a.dob = b.dob AND a.sx = b.sx",
    "EXACT_EMAIL": "SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM na a JOIN nb b ON a.email_n = b.email_n",
    "PHONE7": "SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM na a JOIN nb b ON a.phone7 = b.phone7",
    "POSTCODE_SN3": "SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM na a JOIN nb b ON a.postcode_n = b.postcode_n AND substr(a.family_n, 1, 3) = substr(b.family_n, 1, 3)",
    "SELF_EMAIL": "SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM na a JOIN na b ON a.email_n = b.email_n AND a.family_n = b.family_n AND a.postcode_n = b.postcode_n AND a.id < b.id",
}


def _rule(name: str):
    def run(spark, sf):
        return linkage.standard_rules(*_linked(spark, sf))[name].select("a_id", "b_id")

    run.__doc__ = f"Candidate pairs of the blocking rule {name}."
    return run


for _name, _q in (("EXACT_EMAIL", "block_email"), ("PHONE7", "block_phone7"), ("POSTCODE_SN3", "block_postcode_prefix"), ("SELF_EMAIL", "block_self_inequality"), ("SOUNDEX_CITY", "block_soundex_city"), ("DOB_SOUNDEX", "block_dob_soundex")):
    query(_q, f"WITH {_LINK_SQL} {_RULES_SQL[_name]}" if _name in _RULES_SQL else None)(_rule(_name))

_AB = ("EXACT_EMAIL", "PHONE7", "POSTCODE_SN3", "SOUNDEX_CITY", "DOB_SOUNDEX")
_CAND_SQL = "cand AS (SELECT a_id, b_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS block_rules, 'AB' AS kind FROM (" + " UNION ALL ".join(f"SELECT *, '{r}' AS rule FROM ({_RULES_SQL[r]})" for r in _AB) + ") GROUP BY a_id, b_id)"


def _candidates(spark, sf):
    a, b = _linked(spark, sf)
    rules = linkage.standard_rules(a, b)
    # written once: the steps behind it read the pairs several times
    return a, b, scratch(spark).table(linkage.candidates([rules[r] for r in _AB], "AB"), "pairs")


@query("candidates_rules", f"WITH {_LINK_SQL}, {_CAND_SQL} SELECT kind, a_id, b_id, block_rules FROM cand")
def candidates_rules(spark, sf):
    return _candidates(spark, sf)[2].select("kind", "a_id", "b_id", "block_rules")


_SIG_SQL = """sig AS (SELECT c.*, CASE WHEN a.email_n IS NULL OR b.email_n IS NULL THEN NULL WHEN a.email_n = b.email_n THEN 1000 WHEN a.email_local = b.email_local THEN 600 WHEN a.email_domain = b.email_domain THEN 200 ELSE 0 END AS s_email,
    CASE WHEN a.phone_n IS NULL OR b.phone_n IS NULL THEN NULL WHEN a.phone_n = b.phone_n THEN 1000 WHEN a.phone7 = b.phone7 THEN 700 ELSE 0 END AS s_phone,
    CASE WHEN a.name_base IS NULL OR b.name_base IS NULL THEN NULL ELSE cast(greatest(floor(1000 - 1000 * levenshtein(a.name_base, b.name_base) / greatest(length(a.name_base), length(b.name_base))), CASE WHEN a.family_n = b.family_n AND substr(a.given_n, 1, 1) = substr(b.given_n, 1, 1) THEN 850 ELSE 0 END) AS INT) END AS s_name,
    (CASE WHEN a.postcode_n = b.postcode_n THEN 500 ELSE 0 END) + (CASE WHEN a.street_n = b.street_n THEN 500 WHEN substr(a.street_n, 1, 6) = substr(b.street_n, 1, 6) THEN 300 ELSE 0 END) AS s_addr,
    CASE WHEN a.dob IS NULL OR b.dob IS NULL THEN NULL WHEN a.dob = b.dob THEN 1000 ELSE 0 END AS s_dob,
    CASE WHEN a.suffix IS DISTINCT FROM b.suffix THEN 1 ELSE 0 END AS f_suffix, CASE WHEN a.is_business <> b.is_business THEN 1 ELSE 0 END AS f_business,
    CASE WHEN substr(a.given_n, 1, 1) <> substr(b.given_n, 1, 1) THEN 1 ELSE 0 END AS f_given, CASE WHEN a.family_n = b.family_n THEN 1 ELSE 0 END AS same_family
    FROM cand c JOIN na a ON a.id = c.a_id JOIN nb b ON b.id = c.b_id)"""
_SIG_COLS = "a_id b_id s_email s_phone s_name s_addr s_dob f_suffix f_business f_given same_family".split()


def _signals(spark, sf):
    a, b, c = _candidates(spark, sf)
    return linkage.signals(c, a, b)


@query("signals", f"WITH {_LINK_SQL}, {_CAND_SQL}, {_SIG_SQL} SELECT {', '.join(_SIG_COLS)} FROM sig")
def q_signals(spark, sf):
    return _signals(spark, sf).select(*_SIG_COLS)


_VOTE_SQL = """sc AS (SELECT *, ((top * 20 + weight) // (weight * 2)) / 10000.0 AS score_total FROM (SELECT *, coalesce(s_email, 0) * 30 + coalesce(s_phone, 0) * 20 + coalesce(s_name, 0) * 25 + s_addr * 15 + coalesce(s_dob, 0) * 10 AS top,
        (CASE WHEN s_email IS NULL THEN 0 ELSE 30 END) + (CASE WHEN s_phone IS NULL THEN 0 ELSE 20 END) + (CASE WHEN s_name IS NULL THEN 0 ELSE 25 END) + 15 + (CASE WHEN s_dob IS NULL THEN 0 ELSE 10 END) AS weight FROM sig)),
    vo AS (SELECT *, CASE WHEN s_email = 1000 OR s_phone = 1000 THEN 'MERGE' ELSE 'REJECT' END AS vote_determ, CASE WHEN score_total >= 0.72 THEN 'MERGE' ELSE 'REJECT' END AS vote_prob,
        CASE WHEN s_dob = 0 OR f_suffix + f_business + f_given > 0 THEN 'REJECT' WHEN s_name >= 800 AND (s_dob = 1000 OR s_email = 1000 OR s_phone >= 700 OR s_addr >= 800) THEN 'MERGE' ELSE 'REJECT' END AS vote_skeptic FROM sc),
    pa AS (SELECT *, CASE WHEN vote_determ = vote_prob AND vote_prob = vote_skeptic THEN 'UNANIMOUS_' || vote_prob ELSE 'SPLIT' END AS panel_result FROM vo)"""


def _panel(spark, sf):
    return linkage.panel(linkage.weighted_score(_signals(spark, sf)))


@query("panel_votes", f"WITH {_LINK_SQL}, {_CAND_SQL}, {_SIG_SQL}, {_VOTE_SQL} SELECT a_id, b_id, cast(score_total AS DOUBLE) AS score_total, vote_determ, vote_prob, vote_skeptic, panel_result FROM pa")
def panel_votes(spark, sf):
    return _panel(spark, sf).select("a_id", "b_id", F.col("score_total").cast("double").alias("score_total"), "vote_determ", "vote_prob", "vote_skeptic", "panel_result")


@query("panel_counts", f"WITH {_LINK_SQL}, {_CAND_SQL}, {_SIG_SQL}, {_VOTE_SQL} SELECT panel_result, count(*) AS n FROM pa GROUP BY 1")
def panel_counts(spark, sf):
    return _panel(spark, sf).groupBy("panel_result").agg(F.count(F.lit(1)).alias("n"))


def _word_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'missing' WHEN {c} >= 950 THEN 'same' WHEN {c} >= 600 THEN 'close' ELSE 'different' END"


@query("compare_summary", f"WITH {_LINK_SQL}, {_CAND_SQL}, {_SIG_SQL} SELECT a_id, b_id, concat_ws('; ', " + ", ".join(f"'{k} ' || {_word_sql('s_' + k)}" for k in linkage.WEIGHTS) + ", CASE WHEN f_suffix = 1 THEN 'generation differs' END, CASE WHEN f_business = 1 THEN 'person against firm' END, CASE WHEN f_given = 1 THEN 'given initial differs' END) AS comparison FROM sig")
def compare_summary(spark, sf):
    """What was compared, in words; the gap in years is left to the signals."""
    return linkage.summary(_signals(spark, sf).withColumn("dob_gap", F.lit(None).cast("double"))).select("a_id", "b_id", "comparison")


_VERDICT_SQL = """ve AS (SELECT *, CASE WHEN panel_result = 'UNANIMOUS_MERGE' THEN 'MERGE' ELSE 'REJECT' END AS verdict0 FROM pa),
    deg AS (SELECT node FROM (SELECT DISTINCT a_id AS node, a_id, b_id FROM ve WHERE verdict0 = 'MERGE' UNION ALL SELECT DISTINCT b_id, a_id, b_id FROM ve WHERE verdict0 = 'MERGE') GROUP BY node HAVING count(*) >= 2),
    fl AS (SELECT *, CASE WHEN verdict0 = 'MERGE' AND (a_id IN (SELECT node FROM deg) OR b_id IN (SELECT node FROM deg)) THEN 'FLAG' ELSE verdict0 END AS verdict FROM ve),
    mc AS (SELECT *, CASE WHEN verdict <> 'MERGE' THEN NULL WHEN s_email = 1000 THEN 'EXACT_EMAIL' WHEN s_phone = 1000 AND s_addr >= 500 THEN 'PHONE_ADDRESS' ELSE 'FUZZY_NAME' END AS match_class FROM fl)"""
_ALL_SQL = f"WITH {_LINK_SQL}, {_CAND_SQL}, {_SIG_SQL}, {_VOTE_SQL}, {_VERDICT_SQL}"


def _decided(spark, sf):
    return linkage.match_class(linkage.flag_clusters(linkage.verdicts(_panel(spark, sf))))


@query("closure_flag", f"{_ALL_SQL} SELECT a_id, b_id, verdict FROM mc WHERE verdict <> 'REJECT'")
def closure_flag(spark, sf):
    """Merged pairs; those in groups of more than two records are flagged for people."""
    return _decided(spark, sf).where("verdict <> 'REJECT'").select("a_id", "b_id", "verdict")


@query("match_class", f"{_ALL_SQL} SELECT match_class, count(*) AS n FROM mc WHERE match_class IS NOT NULL GROUP BY 1")
def q_match_class(spark, sf):
    return _decided(spark, sf).where("match_class is not null").groupBy("match_class").agg(F.count(F.lit(1)).alias("n"))


@query("publish_matches", f"{_ALL_SQL} SELECT 'G-' || a_id AS golden_id, a_id, b_id, match_class, panel_result FROM mc WHERE verdict = 'MERGE'")
def publish_matches(spark, sf):
    return _decided(spark, sf).where("verdict = 'MERGE'").select(F.concat(F.lit("G-"), "a_id").alias("golden_id"), "a_id", "b_id", "match_class", "panel_result")


@query("publish_new", f"{_ALL_SQL} SELECT DISTINCT 'G-' || id AS new_golden_id, id AS b_id FROM nb WHERE id NOT IN (SELECT b_id FROM mc WHERE verdict IN ('MERGE', 'FLAG'))")
def publish_new(spark, sf):
    """Records of B that are nobody's match: new customers."""
    _, b = _linked(spark, sf)
    return linkage.new_records(b, _decided(spark, sf)).select(F.concat(F.lit("G-"), "b_id").alias("new_golden_id"), "b_id").distinct()


@query("publish_dedup", f"WITH {_LINK_SQL} SELECT 'G-' || a_id AS keep_golden_id, 'G-' || b_id AS drop_golden_id FROM ({_RULES_SQL['SELF_EMAIL']})")
def publish_dedup(spark, sf):
    """Pairs within A: the smaller id is kept."""
    pairs = linkage.candidates([linkage.standard_rules(*_linked(spark, sf))["SELF_EMAIL"]], "AA")
    return pairs.select(F.concat(F.lit("G-"), "a_id").alias("keep_golden_id"), F.concat(F.lit("G-"), "b_id").alias("drop_golden_id"))


@query("candidate_statistics", f"WITH {_LINK_SQL}, {_CAND_SQL} SELECT (SELECT count(*) FROM na) * (SELECT count(*) FROM nb) AS possible, count(*) AS candidates, round(1 - count(*) / cast((SELECT count(*) FROM na) * (SELECT count(*) FROM nb) AS DOUBLE), 6) AS reduction FROM cand")
def candidate_statistics(spark, sf):
    a, b, c = _candidates(spark, sf)
    n = a.agg(F.count(F.lit(1)).alias("x")).crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("y")))).crossJoin(F.broadcast(c.agg(F.count(F.lit(1)).alias("candidates"))))
    return n.select((F.col("x") * F.col("y")).alias("possible"), "candidates", F.round(1 - F.col("candidates") / (F.col("x") * F.col("y")).cast("double"), 6).alias("reduction"))


@query("score_f1", f"""{_ALL_SQL}, f AS (SELECT DISTINCT a_id, b_id FROM mc WHERE verdict IN ('MERGE', 'FLAG')), t AS (SELECT DISTINCT source_a_ref AS a_id, source_b_ref AS b_id FROM golden_seed WHERE source_a_ref <> '' AND source_b_ref <> ''),
    n AS (SELECT (SELECT count(*) FROM f) AS proposed, (SELECT count(*) FROM f JOIN t USING (a_id, b_id)) AS correct, (SELECT count(*) FROM t) AS true_pairs)
    SELECT proposed, correct, true_pairs, round(correct / proposed, 6) AS precision, round(correct / true_pairs, 6) AS recall, round(2 * (correct / proposed) * (correct / true_pairs) / (correct / proposed + correct / true_pairs), 6) AS f1 FROM n""")
def score_f1(spark, sf):
    """Pairs that were proposed against those that golden rows already join."""
    truth = read_table(spark, sf, "golden_seed").where("source_a_ref <> '' and source_b_ref <> ''").select(F.col("source_a_ref").alias("a_id"), F.col("source_b_ref").alias("b_id"))
    r = linkage.precision_recall(_decided(spark, sf).where("verdict in ('MERGE', 'FLAG')").select("a_id", "b_id"), truth)
    return r.select("proposed", "correct", "true_pairs", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("survivorship", f"""{_ALL_SQL}, b AS (SELECT DISTINCT * FROM source_b), a AS (SELECT DISTINCT * FROM source_a), m AS (SELECT a.cust_id, a.created_at, b.*, nb.dob AS bd FROM mc JOIN a ON a.cust_id = a_id JOIN b ON b.client_ref = b_id JOIN nb ON nb.id = b_id WHERE verdict = 'MERGE')
    SELECT golden_id, coalesce(nullif(g.email, ''), CASE WHEN client_ref IS NOT NULL THEN email_addr END) AS email, coalesce(nullif(g.phone, ''), mobile) AS phone, cast(coalesce(date_of_birth, bd) AS VARCHAR) AS date_of_birth,
      CASE WHEN last_seen > created_at THEN street ELSE addr_line END AS addr_line, CASE WHEN last_seen > created_at THEN town ELSE g.city END AS city, coalesce(client_ref, source_b_ref) AS source_b_ref FROM golden_seed g LEFT JOIN m ON g.source_a_ref = m.cust_id""")
def survivorship(spark, sf):
    """Golden rows after the published matches are merged in."""
    golden = read_table(spark, sf, "golden_seed").withColumn("email", F.nullif(F.col("email"), F.lit(""))).withColumn("phone", F.nullif(F.col("phone"), F.lit("")))
    a = read_table(spark, sf, "source_a").distinct().select(F.col("cust_id").alias("a_id"), F.col("created_at").alias("a_created_at"))
    b = read_table(spark, sf, "source_b").distinct().select(F.col("client_ref").alias("b_id"), F.col("email_addr").alias("b_email"), F.col("mobile").alias("b_phone"), F.col("street").alias("b_addr_line"), F.col("town").alias("b_city"), F.col("zip").alias("b_postcode"), F.col("last_seen").alias("b_last_seen"))
    _, nb = _linked(spark, sf)
    m = _decided(spark, sf).where("verdict = 'MERGE'").select("a_id", "b_id").join(a, "a_id").join(b, "b_id").join(nb.select(F.col("id").alias("b_id"), F.col("dob").alias("b_dob")), "b_id")
    m = m.join(golden.where("source_a_ref is not null").select("golden_id", F.col("source_a_ref").alias("a_id")), "a_id").drop("a_id")
    return linkage.survive(golden, m, F.lit("2026-06-30").cast("timestamp_ntz")).select("golden_id", "email", "phone", F.col("date_of_birth").cast("string").alias("date_of_birth"), "addr_line", "city", "source_b_ref")


# ---- closure on a table of edges, approvals, exports


@query("default_approvals", """WITH d AS (SELECT *, row_number() OVER () AS rn FROM diff_rows), e AS (SELECT DISTINCT golden_id FROM golden_seed), s AS (SELECT DISTINCT 'G-' || a_id AS k FROM candidates WHERE panel_result = 'SPLIT' AND a_id IS NOT NULL)
    SELECT branch_id, key_value, class, CASE WHEN r IN ('UNEXPLAINED', 'PANEL_SPLIT') THEN false ELSE approved END AS approved, r AS default_reason FROM (SELECT d.*, CASE WHEN default_reason = 'DEFAULT' AND (key_value IS NULL OR key_value NOT IN (SELECT golden_id FROM e)) THEN 'UNEXPLAINED' WHEN default_reason = 'DEFAULT' AND key_value IN (SELECT k FROM s) THEN 'PANEL_SPLIT' ELSE default_reason END AS r FROM d)""")
def default_approvals(spark, sf):
    """Recorded differences that nobody decided: refused where unexplained, or where the panel was split."""
    d = read_table(spark, sf, "diff_rows")
    expected = read_table(spark, sf, "golden_seed").select(F.col("golden_id").alias("key_value"))
    split = read_table(spark, sf, "candidates").where("panel_result = 'SPLIT' and a_id is not null").select(F.concat(F.lit("G-"), "a_id").alias("key_value"))
    return linkage.default_approvals(d, expected, split).select("branch_id", "key_value", "class", "approved", "default_reason")


@query("branch_touch_counts", "SELECT branch_id, column_name, cast(sum(t) AS BIGINT) AS touched FROM (" + " UNION ALL ".join(f"SELECT branch_id, '{c}' AS column_name, coalesce((cols_mask >> {i}) & 1, 0) AS t FROM diff_rows" for i, c in enumerate(GOLDEN)) + ") GROUP BY 1, 2")
def branch_touch_counts(spark, sf):
    """How often each branch touched each golden column."""
    return diff.column_touch(read_table(spark, sf, "diff_rows"), GOLDEN, by=("branch_id",))


@query("run_statistics", "SELECT run_id, kind, count(*) AS pairs, count(*) FILTER (upper(trim(verdict)) = 'MERGE') AS merged, count(DISTINCT least(a_id, b_id) || '|' || greatest(a_id, b_id)) AS different FROM candidates GROUP BY 1, 2")
def run_statistics(spark, sf):
    """What each matching run said, by kind of pair."""
    c = read_table(spark, sf, "candidates")
    pair = F.when(F.col("a_id").isNotNull() & F.col("b_id").isNotNull(), F.concat_ws("|", F.least("a_id", "b_id"), F.greatest("a_id", "b_id")))
    one = F.when(F.col("a_id").isNull() | F.col("b_id").isNull(), F.concat(F.coalesce("a_id", "b_id"), F.lit("|"), F.coalesce("a_id", "b_id"))).otherwise(pair)
    return c.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.upper(F.trim("verdict")) == "MERGE", 1)).alias("merged"), F.count_distinct(one).alias("different"))


@query("change_export", f"""WITH {_BRANCH_SQL} SELECT key_value, class, concat_ws(',', {', '.join(f"CASE WHEN (cols_mask >> {i}) & 1 = 1 THEN '{c}' END" for i, c in enumerate(_COLS))}) AS touched, b.c_acctbal AS c_acctbal_before, h.c_acctbal AS c_acctbal_after FROM d LEFT JOIN b ON b.k = key_value LEFT JOIN h ON h.k = key_value""")
def change_export(spark, sf):
    """Decisions with the values of then and now side by side."""
    base, head = _branch(spark, sf)
    return browse.change_export(diff.keyed_diff(base, head, "c_custkey"), base, head, "c_custkey", ["c_acctbal"]).select("key_value", "class", "touched", "c_acctbal_before", "c_acctbal_after")


@query("history_lineage", """WITH nm AS (SELECT cust_id AS reference, min(full_name) AS detail FROM source_a GROUP BY 1 UNION ALL SELECT client_ref, min(concat_ws(' ', first_name, last_name)) FROM source_b GROUP BY 1),
    s AS (SELECT golden_id, 'SOURCE_A' AS kind, source_a_ref AS reference FROM golden_seed WHERE source_a_ref <> '' UNION ALL SELECT golden_id, 'SOURCE_B', source_b_ref FROM golden_seed WHERE source_b_ref <> ''
          UNION ALL SELECT golden_id, 'SOURCE_A_MERGED', unnest(string_split(merged_a_refs, ',')) FROM golden_seed WHERE merged_a_refs <> '')
    SELECT golden_id, kind, reference, detail FROM s LEFT JOIN nm USING (reference)
    UNION ALL SELECT golden_id, 'EVIDENCE', cast(pair_id AS VARCHAR), concat_ws(' ', panel_result, coalesce(trim(verdict), '?')) FROM candidates JOIN golden_seed ON a_id = source_a_ref AND b_id = source_b_ref
    UNION ALL SELECT golden_id, 'CHANGE', branch_id, class FROM diff_rows JOIN golden_seed ON key_value = golden_id""")
def history_lineage(spark, sf):
    """Everything each golden row stems from."""
    t = lambda n: read_table(spark, sf, n)
    return browse.lineage(t("golden_seed"), t("source_a"), t("source_b"), t("candidates"), t("diff_rows"))


@query("audit_join", "SELECT o_orderkey AS merge_id, c_name AS requested_by, n_name AS origin, o_orderstatus AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def audit_join(spark, sf):
    """The merge ledger with its control tables."""
    o, c, n = (read_table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
    return j.select(F.col("o_orderkey").alias("merge_id"), F.col("c_name").alias("requested_by"), F.col("n_name").alias("origin"), F.col("o_orderstatus").alias("status"))


_NEEDLE = "Case mails about REQUEST 1190 and what became of it"


@query("precedent_topk", f"SELECT doc_id AS precedent_id, levenshtein(regexp_replace(translate(text, '{linkage.MARKED}', '{linkage.PLAIN}'), '[^\\x00-\\x7F]', '', 'g'), '{_NEEDLE}') AS distance FROM documents WHERE text IS NOT NULL ORDER BY distance, doc_id DESC LIMIT 3")
def precedent_topk(spark, sf):
    """The three precedents that read most like a context, whole texts compared, marks on letters left aside."""
    d = read_table(spark, sf, "documents").where("text is not null")
    p = d.select(F.col("doc_id").alias("precedent_id"), F.regexp_replace(F.translate("text", linkage.MARKED, linkage.PLAIN), r"[^\x00-\x7F]", "").alias("context"))
    return browse.nearest(p, _NEEDLE, 3).select("precedent_id", F.col("distance").cast("bigint").alias("distance"))


# ---- pages, uploads, events


@query("browse_page", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_nationkey DESC, c_custkey, c_name, c_acctbal, c_mktsegment LIMIT 50 OFFSET 100")
def browse_page(spark, sf):
    return browse.page(read_table(spark, sf, "customer").select(*_COLS), "c_nationkey", descending=True, offset=100)


@query("browse_filter", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE upper(c_name) LIKE '%#0000001%' ESCAPE '!' OR upper(c_mktsegment) LIKE '%#0000001%' ORDER BY c_custkey LIMIT 500")
def browse_filter(spark, sf):
    return browse.page(read_table(spark, sf, "customer").select(*_COLS), limit=9999, needle="#0000001")


_UPLOAD = ["client_ref", "first_name", "last_name", "email_addr", "mobile", "street", "town", "zip", "nation", "dob"]
_VALUE = lambda c: f"CASE WHEN lower(trim({c})) NOT IN ({', '.join(repr(p) for p in delimited.PLACEHOLDERS)}) THEN trim({c}) END"


@query("profile_columns", "SELECT column_name, filled, unique_values FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(v) AS filled, count(DISTINCT v) AS unique_values FROM (SELECT {_VALUE(c)} AS v FROM source_b)" for c in _UPLOAD[1:]) + ")")
def profile_columns(spark, sf):
    """Filled and different values of every column of an upload."""
    return delimited.profile(read_table(spark, sf, "source_b").select(*_UPLOAD), "client_ref").select("column_name", "filled", "unique_values")


@query("column_kinds")
def column_kinds(spark, sf):
    """Kinds of the columns, from the first values of each."""
    return delimited.profile(read_table(spark, sf, "source_b").select(*_UPLOAD), "client_ref").select("column_name", "kind")


@query("date_format_guess", f"WITH v AS (SELECT {_VALUE('dob')} AS v FROM source_b) SELECT 'dd/MM/yyyy' AS format, count(*) FILTER (regexp_matches(v, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') AND try_strptime(v, '%d/%m/%Y') IS NOT NULL) AS n, count(v) AS total, false AS ambiguous FROM v")
def date_format_guess(spark, sf):
    """The pattern that reads most dates of birth, and whether day and month could be exchanged."""
    return delimited.date_formats(read_table(spark, sf, "source_b").select(delimited.value(F.col("dob")).alias("v")))


@query("shared_contacts", f"SELECT contact, count(*) AS n FROM (SELECT right(regexp_replace({_VALUE('mobile')}, '[^0-9]', '', 'g'), 10) AS contact FROM source_b) WHERE contact IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, contact LIMIT 5")
def shared_contacts(spark, sf):
    """Numbers that many customers give."""
    return delimited.shared_contacts(read_table(spark, sf, "source_b"), F.right(F.regexp_replace(delimited.value(F.col("mobile")), r"[^0-9]", ""), F.lit(10)))


@query("contact_overlap", f"SELECT 'email' AS kind, count(*) AS shared FROM (SELECT lower({_VALUE('email')}) AS v FROM source_a INTERSECT SELECT lower({_VALUE('email_addr')}) FROM source_b) WHERE v IS NOT NULL UNION ALL SELECT 'phone', count(*) FROM (SELECT right(regexp_replace({_VALUE('phone')}, '[^0-9]', '', 'g'), 10) AS v FROM source_a INTERSECT SELECT right(regexp_replace({_VALUE('mobile')}, '[^0-9]', '', 'g'), 10) FROM source_b) WHERE v IS NOT NULL")
def contact_overlap(spark, sf):
    mail, tel = (lambda c: F.lower(delimited.value(F.col(c)))), (lambda c: F.right(F.regexp_replace(delimited.value(F.col(c)), r"[^0-9]", ""), F.lit(10)))
    return delimited.overlap(read_table(spark, sf, "source_a"), read_table(spark, sf, "source_b"), {"email": (mail("email"), mail("email_addr")), "phone": (tel("phone"), tel("mobile"))})


_MAP = {"id": "client_ref", "first_name": "first_name", "last_name": "last_name", "email": "email_addr", "phone": "mobile", "address": "street", "city": "town", "postcode": "zip", "country": "nation", "dob": "dob"}


@query("upload_issues", f"""WITH x AS (SELECT client_ref, {_VALUE('first_name')} AS f, {_VALUE('last_name')} AS l, {_VALUE('email_addr')} AS e, {_VALUE('mobile')} AS p, {_VALUE('dob')} AS d FROM source_b),
    i AS (SELECT 'DUPLICATE_ID' AS code, count(*) - count(DISTINCT client_ref) AS n FROM x UNION ALL SELECT 'NO_NAME', count(*) FILTER (f IS NULL AND l IS NULL) FROM x UNION ALL SELECT 'BAD_EMAIL', count(*) FILTER (NOT regexp_matches(e, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) FROM x
      UNION ALL SELECT 'BAD_PHONE', count(*) FILTER (length(regexp_replace(p, '\\D', '', 'g')) < 6) FROM x
      UNION ALL SELECT 'BAD_DOB', count(*) FILTER (d IS NOT NULL AND NOT coalesce(regexp_matches(d, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') AND try_strptime(d, '%d/%m/%Y') >= TIMESTAMP '1900-01-01', false)) FROM x) SELECT code, n FROM i WHERE n > 0""")
def upload_issues(spark, sf):
    """What a quality report says of source_b as an upload."""
    b = read_table(spark, sf, "source_b").withColumn("line", F.concat_ws("|", "client_ref", F.coalesce(F.col("last_seen").cast("string"), F.lit(""))))
    return delimited.normalise_upload(b, _MAP, {"dob": "dd/MM/yyyy"}, "line", "B-")[1].select("code", "n")


@query("upload_loaded", "SELECT count(DISTINCT client_ref) AS loaded FROM source_b")
def upload_loaded(spark, sf):
    b = read_table(spark, sf, "source_b").withColumn("line", F.concat_ws("|", "client_ref", F.coalesce(F.col("last_seen").cast("string"), F.lit(""))))
    return delimited.normalise_upload(b, _MAP, {"dob": "dd/MM/yyyy"}, "line", "B-")[0].agg(F.count(F.lit(1)).alias("loaded"))


@query("event_fold", "SELECT user_id, count(*) AS n, arg_max(event_type, {'ts': ts, 'event_id': event_id}) AS last_kind FROM events GROUP BY user_id")
def event_fold(spark, sf):
    """The state of each key after all its events."""
    return ev.fold(read_table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "n", "last_kind")


@query("event_kpis", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY 1")
def event_kpis(spark, sf):
    return read_table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


@query("event_windows", "SELECT cast(date_trunc('hour', ts) AS VARCHAR) AS started, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def event_windows(spark, sf):
    return ev.tumbling(read_table(spark, sf, "events")).withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


@query("event_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM y GROUP BY user_id, s")
def event_sessions(spark, sf):
    s = ev.sessions(read_table(spark, sf, "events"))
    return s.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("ttl_expired", "SELECT user_id FROM (SELECT user_id, max(ts) AS last_at FROM events GROUP BY 1) WHERE date_diff('second', last_at, TIMESTAMP '2024-01-31 12:00:00') > 43200")
def ttl_expired(spark, sf):
    last = read_table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("at"))
    return ev.expired(last, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"), 43200).select("user_id")


@query("window_row_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def window_row_number(spark, sf):
    return ev.numbered(read_table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("event_id", "seq")


@query("latest_per_key", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_per_key(spark, sf):
    return linkage.latest_per_key(read_table(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id")


@query("recent_events", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def recent_events(spark, sf):
    return ev.recent(read_table(spark, sf, "events"), 40, ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("synthetic_systems")
def synthetic_systems(spark, sf):
    """Rows of two synthetic systems and of their known answer."""
    named = zip(("a", "b", "truth"), synthetic.customers(spark, 20000))
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("what"), "n") for n, df in named])


# ---- review, plans, the state of the system


@query("system_snapshot", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("branch_customers", "candidates", "customer", "diff_rows", "events", "golden_seed", "lineitem", "orders", "source_a", "source_b")))
def system_snapshot(spark, sf):
    """Rows of every table, in one job."""
    names = ("branch_customers", "candidates", "customer", "diff_rows", "events", "golden_seed", "lineitem", "orders", "source_a", "source_b")
    return review.snapshot({t: read_table(spark, sf, t) for t in names}).select("table_name", "n_rows")


@query("review_order", """WITH c AS (SELECT pair_id, panel_result, coalesce(upper(trim(verdict)) = 'MERGE', false) AS approved, a_id FROM candidates), n AS (SELECT a_id, count(*) AS k FROM candidates WHERE a_id IS NOT NULL GROUP BY 1)
    SELECT cast(pair_id AS VARCHAR) AS key_value, CASE WHEN panel_result = 'SPLIT' THEN 0 WHEN coalesce(k, 0) > 2 THEN 1 WHEN NOT approved THEN 3 ELSE 4 END AS review_rank FROM c LEFT JOIN n USING (a_id)""")
def review_order(spark, sf):
    """Candidates in the order in which people should look at them."""
    c = read_table(spark, sf, "candidates")
    size = c.where("a_id is not null").groupBy("a_id").agg(F.count(F.lit(1)).alias("component_size"))
    approved = F.coalesce(F.upper(F.trim("verdict")) == "MERGE", F.lit(False))
    cards = c.join(size, "a_id", "left").select(F.col("pair_id").cast("string").alias("key_value"), F.lit("CHANGED").alias("class"), "panel_result", F.coalesce("component_size", F.lit(0)).alias("component_size"), approved.alias("approved"))
    return review.review_order(cards).select("key_value", "review_rank")


@query("dedup_pair_closure", f"WITH {_LINK_SQL}, d AS (SELECT 'G-' || a_id AS k, 'G-' || b_id AS x FROM ({_RULES_SQL['SELF_EMAIL']})), s AS (SELECT DISTINCT key_value AS v FROM diff_rows WHERE default_reason = 'HUMAN' AND key_value IS NOT NULL) SELECT DISTINCT v AS key_value FROM (SELECT v FROM s UNION ALL SELECT x FROM d JOIN s ON v = k UNION ALL SELECT k FROM d JOIN s ON v = x)")
def dedup_pair_closure(spark, sf):
    """Deciding on one row of a kept and dropped pair decides on both."""
    pairs = publish_dedup(spark, sf)
    decided = read_table(spark, sf, "diff_rows").where("default_reason = 'HUMAN' and key_value is not null")
    return review.closed_keys(decided, pairs)


@query("precedents_standing", """WITH l AS (SELECT user_id AS precedent_id, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'RECORD' WHEN (SELECT max(event_type) FROM events) THEN 'DELETE' ELSE 'CITE' END AS action, event_id AS said_at FROM events),
    w AS (SELECT *, row_number() OVER (PARTITION BY precedent_id ORDER BY said_at DESC) AS n FROM l WHERE action <> 'CITE')
    SELECT precedent_id, (SELECT count(*) FROM l c WHERE c.precedent_id = w.precedent_id AND c.action = 'CITE') AS times_cited FROM w WHERE n = 1 AND action <> 'DELETE' AND precedent_id IN (SELECT precedent_id FROM l WHERE action = 'RECORD')""")
def precedents_standing(spark, sf):
    """A log of recorded, cited and deleted precedents, folded; the event types stand for the actions."""
    e = read_table(spark, sf, "events")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    action = F.when(F.col("event_type") == F.col("lo"), "RECORD").when(F.col("event_type") == F.col("hi"), "DELETE").otherwise("CITE")
    log = e.join(F.broadcast(ends)).select(F.col("user_id").alias("precedent_id"), action.alias("action"), F.col("props").alias("context"), F.lit("SAME_PERSON").alias("verdict"), F.lit("").alias("note"), F.col("event_id").alias("at"))
    return review.standing_precedents(log).select("precedent_id", "times_cited")


@query("allowed_rows", """WITH f AS (SELECT o_custkey, (o_custkey % 11) / 10.0 AS confidence, count(*) FILTER (o_orderstatus = 'F') AS changed FROM orders GROUP BY o_custkey)
    SELECT o_custkey, round(cast(CASE WHEN (1 - confidence) * (CASE WHEN changed > 0 THEN 0.7 ELSE 0 END) > 0 THEN least(30000.0, 200 / ((1 - confidence) * 0.7)) ELSE 30000.0 END AS DOUBLE), 4) AS allowed FROM f""")
def allowed_rows(spark, sf):
    """How many rows each change-set might hold at its confidence."""
    f = read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("changed"))
    f = f.withColumns({"added": F.lit(0), "deleted": F.lit(0), "confidence": (F.col("o_custkey") % 11).cast("double") / 10.0})
    return f.select("o_custkey", F.round(gate.allowed_rows(gate.TIERS[2]), 4).alias("allowed"))


@query("mapping_projection", "SELECT client_ref, upper(trim(last_name)) AS B_FULL_NAME, lower(trim(email_addr)) AS B_EMAIL, coalesce(zip, '') AS B_POSTCODE FROM source_b")
def mapping_projection(spark, sf):
    """Declared expressions, checked and applied."""
    b = read_table(spark, sf, "source_b")
    m = {"FULL_NAME": "upper(trim(last_name))", "EMAIL": "lower(trim(email_addr))", "POSTCODE": "coalesce(zip, '')"}
    for e in m.values():
        playbook.check_expression(spark, e, b)
    return playbook.mapped(b, m).select("client_ref", *[f"B_{f}" for f in m])

from tidemark import catalog_plans  # noqa: E402, F401, registers the queries of engine, publishing and exports
