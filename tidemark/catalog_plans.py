"""Queries of the branch engine, of publishing matches and of exports, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog import _ALL_SQL, _CAND_SQL, _COLS, _LINK_SQL, _candidates, _decided, _linked, query
from tidemark.functions import labels
from tidemark.operators import browse, export, linkage, score
from tidemark.plans.branch import Engine
from tidemark.session import shared_dir
from tidemark.sources import upload
from tidemark.sources.tables import read_table
from tidemark.store import Store
from tidemark.streaming import events as ev


# ---- the engine: a recorded plan replayed in a branch, applied, and undone


def _engine(spark: SparkSession, sf: str, rows: DataFrame) -> Engine:
    store = Store(spark, f"{shared_dir(spark).removeprefix('file://')}/store-{uuid.uuid4().hex[:12]}")
    store.create("GOLDEN.CUSTOMERS", rows, "c_custkey")
    return Engine(spark, store)


_PLAN = (
    "UPDATE GOLDEN.CUSTOMERS SET c_mktsegment = 'MOVED' WHERE c_custkey % 50 = 3",
    "DELETE FROM GOLDEN.CUSTOMERS WHERE c_custkey % 400 = 7",
    "INSERT INTO GOLDEN.CUSTOMERS (c_custkey, c_name, c_nationkey) SELECT c_custkey + 5000000, c_name, c_nationkey FROM GOLDEN.CUSTOMERS WHERE c_custkey % 100 = 1",
)
_AFTER = """SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 50 = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 400 <> 7
    UNION ALL SELECT c_custkey + 5000000, c_name, c_nationkey, NULL, NULL FROM customer WHERE c_custkey % 100 = 1 AND c_custkey % 400 <> 7"""


def _replayed(spark: SparkSession, sf: str) -> tuple[Engine, dict]:
    engine = _engine(spark, sf, read_table(spark, sf, "customer").select(*_COLS))
    branch = engine.open_branch("replay")
    for sql in _PLAN:
        engine.run(branch, sql)
    return engine, engine.request_merge(branch, 0.99, tier=3)


@query("engine_replay", _AFTER)
def engine_replay(spark, sf):
    """The governed table after a recorded plan ran in a branch and its change-set was applied."""
    return _replayed(spark, sf)[0].store.read("GOLDEN.CUSTOMERS")


@query("engine_undo", f"SELECT {', '.join(_COLS)} FROM customer")
def engine_undo(spark, sf):
    """The table after the applied change-set was undone: what it was."""
    engine, merge = _replayed(spark, sf)
    engine.unmerge(merge["merge_id"])
    return engine.store.read("GOLDEN.CUSTOMERS")


@query("engine_review", "SELECT cast(c_custkey AS VARCHAR) AS key_value, 'CHANGED' AS class, CASE WHEN c_custkey % 100 = 3 THEN false ELSE true END AS approved, CASE WHEN c_custkey = 53 THEN 'HUMAN' WHEN c_custkey % 100 = 3 THEN 'UNEXPLAINED' ELSE 'DEFAULT' END AS default_reason, 'PENDING' AS status, 'ROWS_NEED_REVIEW' AS reason FROM customer WHERE c_custkey % 50 = 3")
def engine_review(spark, sf):
    """Default approvals inside the engine: rows nobody expected are refused and hold the change-set up for review."""
    engine = _engine(spark, sf, read_table(spark, sf, "customer").select(*_COLS))
    expected = read_table(spark, sf, "customer").where("c_custkey % 100 <> 3").select(F.col("c_custkey").cast("string").alias("key_value"))
    engine.defaults = lambda _, d: linkage.default_approvals(d, expected, expected.limit(0)).select(d.columns)
    branch = engine.open_branch("review")
    engine.run(branch, _PLAN[0])
    engine.set_approval(branch, "GOLDEN.CUSTOMERS", ["53"], True)
    merge = engine.request_merge(branch, 0.99, tier=3)
    return engine.diff(branch, "GOLDEN.CUSTOMERS").select("key_value", "class", "approved", "default_reason", F.lit(merge["status"]).alias("status"), F.lit(merge["reason"]).alias("reason"))


# ---- groups of merged pairs, publishing, survivorship of all classes


_MERGED_SQL = r"""p AS (SELECT DISTINCT 'A:' || a_id AS x, CASE WHEN kind = 'AA' THEN 'A:' ELSE 'B:' END || b_id AS y FROM candidates
        WHERE upper(trim(verdict)) = 'MERGE' AND a_id IS NOT NULL AND b_id IS NOT NULL AND kind IS NOT NULL),
    n AS (SELECT x, y FROM p WHERE x <> y UNION SELECT y, x FROM p WHERE x <> y),
    r(v, m) AS (SELECT x, x FROM n UNION SELECT n.y, r.m FROM r JOIN n ON n.x = r.v WHERE r.m < n.y),
    g AS (SELECT v AS node, min(m) AS component FROM r GROUP BY v)"""


@query("closure_groups", f"WITH RECURSIVE {_MERGED_SQL} SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM g")
def closure_groups(spark, sf):
    """Group and size of every record in a merged pair; ids of A and B are told apart."""
    merged = read_table(spark, sf, "candidates").where("upper(trim(verdict)) = 'MERGE' and kind is not null")
    return linkage.components(linkage.named_nodes(merged))


def _published(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    a, b = _linked(spark, sf)
    return linkage.publish(_decided(spark, sf), a, b)


_DEDUP = "d AS (SELECT DISTINCT a_id, b_id, panel_result FROM candidates WHERE kind = 'AA' AND upper(trim(verdict)) = 'MERGE' AND a_id < b_id)"


def _dedup(spark: SparkSession, sf: str) -> DataFrame:
    pairs = read_table(spark, sf, "candidates").where("kind = 'AA' and upper(trim(verdict)) = 'MERGE' and a_id < b_id").select("a_id", "b_id", "panel_result").distinct()
    return linkage.publish(pairs.withColumn("verdict", F.lit("MERGE")).withColumn("kind", F.lit("AA")).withColumn("match_class", F.lit("INTERNAL_DEDUP")), pairs.select(F.col("a_id").alias("id")), pairs.select(F.col("b_id").alias("id")))["dedup"]


@query(
    "expected_keys",
    f"""{_ALL_SQL} SELECT match_class AS class, 'G-' || a_id AS key_value FROM mc WHERE verdict = 'MERGE'
    UNION ALL SELECT DISTINCT 'NEW_CUSTOMERS', 'G-' || id FROM nb WHERE id NOT IN (SELECT b_id FROM mc WHERE verdict IN ('MERGE', 'FLAG'))""",
)
def expected_keys(spark, sf):
    """The golden keys that each class of a run may touch."""
    p = _published(spark, sf)
    return _union([linkage.expected_keys(p, c).select(F.lit(c).alias("class"), "key_value") for c in linkage.CLASSES])


@query("expected_keys_dedup", f"WITH {_DEDUP} SELECT true AS split_only, 'G-' || unnest([a_id, b_id]) AS key_value FROM d WHERE panel_result = 'SPLIT' UNION ALL SELECT false, 'G-' || unnest([a_id, b_id]) FROM d")
def expected_keys_dedup(spark, sf):
    """Keep and drop keys of duplicates within A, all and those the panel was split on."""
    p = {"dedup": _dedup(spark, sf)}
    return _union([linkage.expected_keys(p, "INTERNAL_DEDUP", s).select(F.lit(s).alias("split_only"), "key_value") for s in (True, False)])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("survive_dedup", f"""WITH {_DEDUP}, t AS (SELECT 'G-' || a_id AS golden_id, string_agg(DISTINCT b_id, ',' ORDER BY b_id) AS refs FROM d GROUP BY a_id)
    SELECT golden_id, full_name, coalesce(refs, merged_a_refs) AS merged_a_refs FROM golden_seed LEFT JOIN t USING (golden_id) WHERE golden_id NOT IN (SELECT 'G-' || b_id FROM d)""")
def survive_dedup(spark, sf):
    """Golden rows after duplicates within A were absorbed."""
    return linkage.absorb(read_table(spark, sf, "golden_seed"), _dedup(spark, sf), F.lit("2026-06-30").cast("timestamp_ntz")).select("golden_id", "full_name", "merged_a_refs")


@query("survive_new", f"""{_ALL_SQL}, w AS (SELECT DISTINCT id FROM nb WHERE id NOT IN (SELECT b_id FROM mc WHERE verdict IN ('MERGE', 'FLAG')))
    SELECT golden_id, full_name, email, source_b_ref, survivorship FROM golden_seed
    UNION ALL SELECT 'G-' || id, full_name, email, id, '{{"ALL":"B"}}' FROM w JOIN (SELECT DISTINCT client_ref, concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')) AS full_name, email_addr AS email FROM source_b) s ON s.client_ref = w.id""")
def survive_new(spark, sf):
    """Golden rows with the new customers of B inserted."""
    b = read_table(spark, sf, "source_b").select(F.col("client_ref").alias("b_id"), F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit(""))).alias("full_name"), F.col("email_addr").alias("email")).distinct()
    out = linkage.insert_new(read_table(spark, sf, "golden_seed"), _published(spark, sf)["new_customers"], b, F.lit("2026-06-30").cast("timestamp_ntz"))
    return out.select("golden_id", "full_name", "email", "source_b_ref", "survivorship")


# ---- control tables and exports, over the recorded differences


_LEDGER = """m AS (SELECT branch_id, count(*) AS total_changed, count(*) FILTER (approved) AS rows_applied, count(*) FILTER (NOT approved) AS rows_excluded FROM diff_rows WHERE branch_id IS NOT NULL GROUP BY branch_id),
    b AS (SELECT DISTINCT branch_id, target_table AS defect_class FROM diff_rows WHERE branch_id IS NOT NULL AND target_table IS NOT NULL QUALIFY row_number() OVER (PARTITION BY branch_id ORDER BY target_table) = 1)"""


def _ledger(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = read_table(spark, sf, "diff_rows").where("branch_id is not null")
    merges = d.groupBy("branch_id").agg(F.count(F.lit(1)).alias("total_changed"), F.count(F.when(F.col("approved"), 1)).alias("rows_applied"), F.count(F.when(~F.col("approved"), 1)).alias("rows_excluded"))
    return merges, d.groupBy("branch_id").agg(F.min("target_table").alias("defect_class")).where("defect_class is not null")


@query("audit_log", f"WITH {_LEDGER} SELECT branch_id AS \"Branch\", defect_class AS \"Change type\", total_changed AS \"Rows changed\", rows_applied AS \"Rows applied\", rows_excluded AS \"Rows left out\" FROM m LEFT JOIN b USING (branch_id)")
def audit_log(spark, sf):
    """The audit of recorded change-sets with its 23 columns, of which those are shown that the records have."""
    full = export.audit(*_ledger(spark, sf))
    assert len(full.columns) == 23
    return full.select("Branch", "Change type", "Rows changed", "Rows applied", "Rows left out")


@query("pending_list", f"WITH {_LEDGER} SELECT branch_id, defect_class, total_changed FROM m JOIN b USING (branch_id) WHERE rows_excluded > 0")
def pending_list(spark, sf):
    """Change-sets with refused rows and their branches: an inner join of control tables."""
    merges, branches = _ledger(spark, sf)
    return merges.where("rows_excluded > 0").join(branches, "branch_id").select("branch_id", "defect_class", "total_changed")


@query("optional_filters", "SELECT 'class' AS asked, count(*) AS n FROM diff_rows WHERE class = 'CHANGED' UNION ALL SELECT 'both', count(*) FROM diff_rows WHERE class = 'CHANGED' AND approved UNION ALL SELECT 'none', count(*) FROM diff_rows")
def optional_filters(spark, sf):
    """Filters by parameters of which unset ones don't filter."""
    d = read_table(spark, sf, "diff_rows")
    asked = {"class": {"class": "CHANGED", "approved": None}, "both": {"class": "CHANGED", "approved": True}, "none": {}}
    return _union([browse.filtered(d, **p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("asked"), "n") for k, p in asked.items()])


@query("catalogue_names", "SELECT DISTINCT branch_id FROM diff_rows WHERE branch_id LIKE 'BR!_%' ESCAPE '!'")
def catalogue_names(spark, sf):
    """Names that begin with a prefix in which an underscore means itself."""
    return read_table(spark, sf, "diff_rows").where(F.expr("branch_id like 'BR!_%' escape '!'")).select("branch_id").distinct()


@query("lookup_list", "SELECT golden_id, full_name FROM golden_seed WHERE golden_id IN (SELECT DISTINCT key_value FROM diff_rows WHERE class IN ('CHANGED', 'ADDED'))")
def lookup_list(spark, sf):
    """Golden rows of recorded keys, of listed classes."""
    keys = read_table(spark, sf, "diff_rows").where(F.col("class").isin("CHANGED", "ADDED")).select(F.col("key_value").alias("golden_id")).distinct()
    return read_table(spark, sf, "golden_seed").join(keys, "golden_id", "left_semi").select("golden_id", "full_name")


@query("risk_labels", "SELECT branch_id, CASE WHEN score <= 0 THEN 'none' WHEN score < 50 THEN 'low' WHEN score < 200 THEN 'medium' ELSE 'high' END AS label FROM (SELECT branch_id, count(*) * 0.7 AS score FROM diff_rows GROUP BY branch_id)")
def risk_labels(spark, sf):
    """The word for a change-set's risk."""
    return read_table(spark, sf, "diff_rows").groupBy("branch_id").agg((F.count(F.lit(1)) * 0.7).alias("score")).select("branch_id", labels.risk(F.col("score")).alias("label"))


@query("uploaded_golden", "WITH a AS (SELECT * FROM source_a WHERE cust_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cust_id ORDER BY created_at DESC NULLS LAST, coalesce(full_name, '')) = 1) SELECT 'G-' || cust_id AS golden_id, full_name, email, source_a_ref FROM (SELECT *, cust_id AS source_a_ref FROM a)")
def uploaded_golden(spark, sf):
    """The golden table that loading an upload seeds: one row a record of A."""
    rows = read_table(spark, sf, "source_a")
    newest = rows.withColumn("__n", F.row_number().over(browse.by("cust_id").orderBy(F.col("created_at").desc_nulls_last(), F.coalesce("full_name", F.lit(""))))).where("__n = 1 and cust_id is not null")
    engine = _engine(spark, sf, read_table(spark, sf, "customer").limit(0).select(*_COLS))
    upload.load(engine.store, newest.drop("__n"), read_table(spark, sf, "source_b").dropDuplicates(["client_ref"]))
    return engine.store.read("GOLDEN.UPLOADED").select("golden_id", "full_name", "email", "source_a_ref")


# ---- scoring and the event log's folds


_KEY_SQL = """k AS (SELECT a_id, b_id, max(m) AS m, max(d) AS d FROM (SELECT DISTINCT source_a_ref AS a_id, source_b_ref AS b_id, 1 AS m, 0 AS d FROM branch_customers WHERE source_a_ref <> '' AND source_b_ref <> ''
      UNION ALL SELECT DISTINCT a_id, b_id, 0, 1 FROM candidates WHERE verdict = 'REJECT' AND kind = 'AB' AND a_id IS NOT NULL AND b_id IS NOT NULL) GROUP BY a_id, b_id),
    c AS (SELECT DISTINCT a_id, b_id FROM candidates WHERE kind = 'AB' AND verdict = 'MERGE'), g AS (SELECT source_a_ref AS a_id, source_b_ref AS b_id FROM golden_seed WHERE source_a_ref <> '' AND source_b_ref <> '')"""


@query("score_run", f"""WITH {_KEY_SQL} SELECT (SELECT count(*) FROM c) AS merged_pairs, (SELECT count(*) FROM c JOIN k USING (a_id, b_id) WHERE m = 1) AS tp, (SELECT count(*) FROM c JOIN k USING (a_id, b_id) WHERE d = 1) AS decoys_merged,
    (SELECT sum(m) FROM k) AS true_pairs, (SELECT count(*) FROM g LEFT JOIN k USING (a_id, b_id) WHERE coalesce(m, 0) = 0) AS false_merges_ab, (SELECT count(*) FROM g JOIN k USING (a_id, b_id) WHERE d = 1) AS decoy_false_merges, (SELECT count(*) FROM g) AS enriched""")
def score_run(spark, sf):
    """A recorded run against the other system's copy as answer key, pairs it refused as decoys."""
    other = read_table(spark, sf, "branch_customers").where("source_a_ref <> '' and source_b_ref <> ''").select(F.col("source_a_ref").alias("a_id"), F.col("source_b_ref").alias("b_id")).distinct()
    c = read_table(spark, sf, "candidates")
    refused = c.where("verdict = 'REJECT' and kind = 'AB' and a_id is not null and b_id is not null").select("a_id", "b_id").distinct()
    key = other.select("a_id", "b_id", F.lit(True).alias("is_match"), F.lit(False).alias("is_decoy")).unionByName(refused.select("a_id", "b_id", F.lit(False).alias("is_match"), F.lit(True).alias("is_decoy")))
    dups = other.select("a_id", F.col("b_id").alias("a_dup_id")).limit(0)
    return score.score(c, read_table(spark, sf, "golden_seed"), key, dups).select("merged_pairs", "tp", "decoys_merged", "true_pairs", "false_merges_ab", "decoy_false_merges", "enriched")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "run.started").when(F.col("o_orderkey") % 5 == 1, "run.ended").when(F.col("o_orderkey") % 5 == 2, "policy.adapted").otherwise("golden.fingerprint")
    payload = F.to_json(F.struct(F.lit("m").alias("mode"), (F.col("o_orderkey") % 4).alias("tier"), (F.col("o_orderkey") % 2 == 0).alias("gate_enabled"), ((F.col("o_orderkey") % 9) / 10).alias("min_confidence"), ((F.col("o_orderkey") % 7) / 10).alias("min_confidence_after"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("table"), F.col("o_orderstatus").alias("fingerprint")))
    return o.select(kind.alias("type"), F.format_string("%012d", "o_orderkey").alias("ts"), (F.col("o_custkey") % 50).cast("string").alias("run_id"), F.lit(None).cast("string").alias("branch_id"), payload.alias("payload"))


@query("event_runs", """WITH o AS (SELECT *, o_orderkey % 5 AS k, printf('%012d', o_orderkey) AS ts, cast(o_custkey % 50 AS VARCHAR) AS run_id FROM orders)
    SELECT run_id, max_by(o_orderkey % 4, ts) FILTER (k = 0) AS tier, max_by(CASE WHEN k = 0 THEN (o_orderkey % 9) / 10.0 ELSE (o_orderkey % 7) / 10.0 END, ts) FILTER (k IN (0, 2)) AS min_confidence,
      min(ts) FILTER (k = 0) AS started, max_by(o_orderstatus, ts) FILTER (k = 1) AS status, max(ts) FILTER (k = 1) AS ended FROM o GROUP BY run_id""")
def event_runs(spark, sf):
    """What became of every run in the log."""
    return ev.run_states(_log(spark, sf)).select("run_id", "tier", "min_confidence", "started", "status", "ended")


@query("event_golden_history", """WITH o AS (SELECT o_orderpriority AS "table", printf('%012d', o_orderkey) AS ts, o_orderstatus AS fingerprint FROM orders WHERE o_orderkey % 5 > 2)
    SELECT *, CASE WHEN lag(fingerprint) OVER (PARTITION BY "table" ORDER BY ts, fingerprint) <> fingerprint THEN 'merge' ELSE 'observed' END AS cause FROM o""")
def event_golden_history(spark, sf):
    """Observed fingerprints of each table and what changed them."""
    return ev.golden_history(_log(spark, sf))


@query("event_throttled", "SELECT max_by(user_id, (ts, event_id)) AS user_id, max(ts) AS ts FROM events GROUP BY time_bucket(INTERVAL '1 hour', ts)")
def event_throttled(spark, sf):
    """The newest event of every hour."""
    e = read_table(spark, sf, "events").select("ts", "event_id", "user_id")
    return ev.throttled(e, "ts", "1 hour").select("user_id", "ts")


@query("candidate_rule_counts", f"WITH {_LINK_SQL}, {_CAND_SQL}, e AS (SELECT unnest(string_split(block_rules, ',')) AS rule, block_rules FROM cand) SELECT rule, count(*) AS pairs, count(*) FILTER (block_rules = rule) AS alone FROM e GROUP BY rule")
def candidate_rule_counts(spark, sf):
    """How many candidates each blocking rule finds, and how many no other rule does."""
    each = _candidates(spark, sf)[2].select("block_rules", F.explode(F.split("block_rules", ",")).alias("rule"))
    return each.groupBy("rule").agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("block_rules") == F.col("rule"), 1)).alias("alone"))


@query("event_narrative", "SELECT printf('%012d', o_orderkey) AS ts, CASE o_orderkey % 5 WHEN 0 THEN 'run.started' WHEN 1 THEN 'run.ended' WHEN 2 THEN 'policy.adapted' ELSE 'golden.fingerprint' END || ' ' || o_orderstatus AS text FROM orders ORDER BY ts DESC LIMIT 40")
def event_narrative(spark, sf):
    """The last forty events in words."""
    return ev.narrative(_log(spark, sf)).select("ts", "text")
