import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import Fingerprint, fingerprint, hashed
from tidemark.operators.diff import keyed_diff
from tidemark.operators import browse, diff, gate, linkage, review
from tidemark.operators.checksum_diff import checksum_diff
from tidemark.plans import playbook
from tidemark.plans.branch import Engine
from tidemark.plans.retarget import BranchState, retarget
from tidemark.sources import delimited, synthetic
from tidemark.store import Store, StoreError
from tidemark.streaming import events as ev


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# fingerprints


def test_fingerprint_is_order_independent_and_additive(spark):
    data = [(i, f"n{i % 7}", None if i % 3 else "") for i in range(200)]
    schema = "k long, a string, b string"
    whole = fingerprint(spark.createDataFrame(data, schema))
    random.Random(1).shuffle(data)
    assert fingerprint(spark.createDataFrame(data, schema).repartition(5)) == whole
    parts = fingerprint(spark.createDataFrame(data[:50], schema)) + fingerprint(spark.createDataFrame(data[50:], schema))
    assert parts == whole and whole - whole == Fingerprint()
    assert fingerprint(spark.createDataFrame([], schema)) == Fingerprint()


def test_null_and_empty_text_hash_alike_and_columns_do_not_run_together(spark):
    h = [r["h"] for r in hashed(spark.createDataFrame([("a", None), ("a", ""), ("", "a"), ("a|1:b", "")], "x string, y string")).collect()]
    assert h[0] == h[1] and len(set(h)) == 3


# checksum diff


def brute_checksum(left, right, columns):
    canon = lambda v: "" if v is None else str(v)
    group = lambda t: {k: sorted({tuple(map(canon, r)) for r in t if canon(r[0]) == k}) for k in {canon(r[0]) for r in t}}
    a, b, out = group(left), group(right), set()
    for k in a.keys() | b.keys():
        if k not in a or k not in b:
            out.add((k, "ADDED" if k not in a else "DELETED", (1 << columns) - 1))
            continue
        ends = lambda t, i: (min(r[i] for r in t), max(r[i] for r in t))
        mask = sum(1 << i for i in range(1, columns) if ends(a[k], i) != ends(b[k], i))
        if mask:
            out.add((k, "CHANGED", mask))
    return out


@pytest.mark.parametrize("buckets", [1, 7, 1 << 18])
def test_checksum_diff_equals_brute_force(spark, buckets):
    rnd = random.Random(buckets)
    left = [(f"k{i}", rnd.choice(["x", "y", None, ""]), rnd.choice(["1", "2"])) for i in range(120)]
    right = [(k, rnd.choice([v, v, v, "z"]), w) for k, v, w in left if rnd.random() > 0.1] + [(f"n{i}", None, "1") for i in range(5)]
    left += left[:9] + [(None, "a", "b"), ("k1", "other", "2")]
    right += right[:9]
    schema = "k string, v string, w string"
    got = checksum_diff(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema + ", extra int".replace(", extra int", "")), "k", buckets=buckets)
    assert {tuple(r) for r in got.collect()} == brute_checksum(left, right, 3)


def test_checksum_diff_of_empty_tables_and_extra_columns(spark):
    empty = spark.createDataFrame([], "k string, v string")
    one = spark.createDataFrame([("a", "1", 5)], "k string, v string, class int")
    assert rows(checksum_diff(empty, empty, "k")) == []
    assert rows(checksum_diff(empty, one, "k", ["k", "v"])) == [("a", "ADDED", 3)]
    assert rows(checksum_diff(one, empty, "k", ["k", "v"])) == [("a", "DELETED", 3)]


def test_checksum_diff_cuts_times_to_the_millisecond(spark):
    at = lambda us: datetime.datetime(2026, 1, 1, 1, 1, 1, us)
    schema = "k string, t timestamp_ntz"
    l, r = [("a", at(1000)), ("b", at(1000))], [("a", at(1999)), ("b", at(2000))]
    assert rows(checksum_diff(spark.createDataFrame(l, schema), spark.createDataFrame(r, schema), "k")) == [("b", "CHANGED", 2)]


# gate


def decided(spark, tier=2, **kw):
    f = {"added": 0, "changed": 0, "deleted": 0, "table_rows": 10000, "needs_review": 0, "hard_blocks": "", "confidence": 0.99} | {k: v for k, v in kw.items() if k not in ("gate_enabled", "min_confidence")}
    df = spark.createDataFrame([tuple(f.values())], "added long, changed long, deleted long, table_rows long, needs_review long, hard_blocks string, confidence double")
    r = gate.decide(df, gate.TIERS[tier], kw.get("gate_enabled", True), kw.get("min_confidence", 0.0)).first()
    return r["decision"], r["reason"]


@pytest.mark.parametrize(
    "expected, facts",
    [
        (("MERGE", "WITHIN_TIER"), {"changed": 100}), (("PENDING", "TIER_0_CANNOT_MERGE"), {"tier": 0, "changed": 1}), (("PENDING", "TIER_1_CANNOT_MERGE"), {"tier": 1, "changed": 1}),
        (("PENDING", "TOO_MANY_ROWS"), {"changed": 30001}), (("PENDING", "DELETE_PCT"), {"deleted": 150}), (("BLOCKED", "DELETE_PCT_EXCEEDED"), {"deleted": 600}), (("BLOCKED", "DELETE_PCT_EXCEEDED"), {"deleted": 600, "gate_enabled": False}),
        (("MERGE", "GATE_DISABLED"), {"changed": 99999, "gate_enabled": False}), (("PENDING", "RISK"), {"changed": 1000, "confidence": 0.5}), (("PENDING", "ROWS_NEED_REVIEW"), {"changed": 5, "needs_review": 1}),
        (("PENDING", "BELOW_MIN_CONFIDENCE"), {"changed": 5, "confidence": 0.6, "min_confidence": 0.7}), (("BLOCKED", "BASE_DRIFT"), {"changed": 5, "hard_blocks": "BASE_DRIFT"}),
        (("PENDING", "RISK"), {"changed": 300, "confidence": None}), (("MERGE", "WITHIN_TIER"), {"table_rows": 0, "added": 3}),
    ],
)
def test_gate_ladder(spark, expected, facts):
    assert decided(spark, **facts) == expected


def test_policy_only_tightens():
    assert gate.tightened(0.5, "WRONG_MATCH") == pytest.approx(0.55)
    assert gate.tightened(0.97, "WRONG_MATCH") == pytest.approx(0.98)
    assert gate.tightened(0.99, "WRONG_MATCH") == 0.99 and gate.tightened(0.5, "OTHER") == 0.5


# branches


@pytest.fixture
def engine(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create("GOLDEN.CUSTOMERS", spark.createDataFrame([(f"G{i:04d}", f"name {i}", i % 5) for i in range(1000)], "ID string, NAME string, GRP int").coalesce(1), "ID")
    store.create("SOURCE_A.CUSTOMERS", spark.createDataFrame([(f"G{i:04d}",) for i in range(0, 40)], "ID string").coalesce(1))
    return Engine(spark, store, clock=lambda: engine_clock[0])


engine_clock = [0.0]


def test_branch_changes_only_itself_and_merges_exactly(engine):
    b = engine.open_branch()
    before = engine.store.fingerprint("GOLDEN.CUSTOMERS")
    engine.run(b, "UPDATE GOLDEN.CUSTOMERS SET NAME = upper(NAME) WHERE GRP = 1 AND ID < 'G0685'")
    assert engine.run(b, "SELECT count(*) AS n FROM GOLDEN_V.CUSTOMERS WHERE NAME LIKE 'NAME%'").first()["n"] == 137
    assert engine.store.fingerprint("GOLDEN.CUSTOMERS") == before
    d = engine.diff(b, "GOLDEN.CUSTOMERS")
    assert d.count() == 137 and d.select("class", "cols_mask").distinct().collect() == [("CHANGED", 2)]
    keys = [r["key_value"] for r in d.orderBy("key_value").limit(3).collect()]
    engine.set_approval(b, "GOLDEN.CUSTOMERS", keys, False)
    m = engine.request_merge(b, 0.99)
    assert (m["status"], m["applied"], m["refused"]) == ("MERGED", 134, 3)
    after = engine.store.read("GOLDEN.CUSTOMERS")
    assert after.where(F.col("NAME").startswith("NAME")).count() == 134
    engine.unmerge(m["merge_id"])
    assert engine.store.fingerprint("GOLDEN.CUSTOMERS") == before and fingerprint(engine.store.read("GOLDEN.CUSTOMERS")) == before


def test_undo_goes_newest_first_and_drift_is_by_key(engine):
    one, two, three = (engine.open_branch() for _ in range(3))
    engine.run(one, "UPDATE GOLDEN.CUSTOMERS SET NAME = 'x' WHERE ID = 'G0001'")
    engine.run(two, "DELETE FROM GOLDEN.CUSTOMERS WHERE ID IN (SELECT ID FROM SOURCE_A.CUSTOMERS WHERE ID = 'G0002')")
    engine.run(three, "UPDATE GOLDEN.CUSTOMERS SET NAME = 'y' WHERE ID = 'G0001'")
    m1, m2, m3 = engine.request_merge(one, 0.99), engine.request_merge(two, 0.99), engine.request_merge(three, 0.99)
    assert (m1["status"], m2["status"]) == ("MERGED", "MERGED")
    assert (m3["status"], m3["reason"]) == ("BLOCKED", "BASE_DRIFT")
    with pytest.raises(StoreError, match="UNMERGE_SUPERSEDED"):
        engine.unmerge(m1["merge_id"])
    engine.unmerge(m2["merge_id"])
    engine.unmerge(m1["merge_id"])
    assert engine.store.read("GOLDEN.CUSTOMERS").count() == 1000


def test_mass_delete_blocks_tier_waits_and_branches_expire(engine):
    b = engine.open_branch()
    engine.run(b, "DELETE FROM GOLDEN.CUSTOMERS WHERE GRP IN (1, 2)")
    assert engine.request_merge(b, 1.0, tier=3)["reason"] == "DELETE_PCT_EXCEEDED"
    c = engine.open_branch()
    engine.run(c, "INSERT INTO GOLDEN.CUSTOMERS (ID, NAME) VALUES ('G9999', 'new')")
    m = engine.request_merge(c, 0.99, tier=0)
    assert m["status"] == "PENDING"
    engine_clock[0] += 4000
    assert engine.sweep() == [b]
    assert engine.apply(m["merge_id"])["status"] == "MERGED"
    assert engine.store.read("GOLDEN.CUSTOMERS").where("ID = 'G9999'").first()["GRP"] is None
    engine_clock[0] = 0.0


def test_created_tables_and_truncate_stay_in_the_branch(engine):
    b = engine.open_branch()
    engine.run(b, f"CREATE TABLE {b}.TMP AS SELECT ID, GRP FROM GOLDEN.CUSTOMERS WHERE GRP = 0")
    engine.run(b, f"UPDATE {b}.TMP SET GRP = 9")
    assert engine.run(b, f"SELECT sum(GRP) AS s FROM {b}.TMP").first()["s"] == 1800
    engine.run(b, "TRUNCATE TABLE GOLDEN.CUSTOMERS")
    assert engine.run(b, "SELECT count(*) AS n FROM GOLDEN.CUSTOMERS").first()["n"] == 0
    engine.discard(b)
    assert engine.store.read("GOLDEN.CUSTOMERS").count() == 1000
    with pytest.raises(StoreError, match="BRANCH_NOT_OPEN"):
        engine.run(b, "SELECT 1 AS x")


def test_merge_statement_and_ambiguous_source(engine):
    b = engine.open_branch()
    engine.run(b, "MERGE INTO GOLDEN.CUSTOMERS c USING (SELECT ID, 'm' AS N FROM SOURCE_A.CUSTOMERS) s ON c.ID = s.ID WHEN MATCHED THEN UPDATE SET NAME = s.N WHEN NOT MATCHED THEN INSERT (ID, NAME) VALUES (s.ID, s.N)")
    assert engine.diff(b, "GOLDEN.CUSTOMERS").count() == 40
    with pytest.raises(StoreError, match="MERGE_AMBIGUOUS"):
        engine.run(b, "MERGE INTO GOLDEN.CUSTOMERS c USING (SELECT GRP FROM GOLDEN.CUSTOMERS) s ON c.GRP = s.GRP WHEN MATCHED THEN UPDATE SET NAME = 'z'")


@pytest.mark.parametrize(
    "code, sql",
    [
        ("MULTI_STATEMENT", "SELECT 1; DROP TABLE GOLDEN.CUSTOMERS"), ("PRIVILEGE", "GRANT SELECT ON GOLDEN.CUSTOMERS TO PUBLIC"), ("TRANSACTION", "COMMIT"), ("SESSION", "SET x = 1"), ("SESSION", "USE golden"),
        ("DDL", "ALTER TABLE GOLDEN.CUSTOMERS ADD COLUMN x int"), ("DDL", "CREATE VIEW GOLDEN.V AS SELECT 1"), ("UNSUPPORTED_STATEMENT", "EXPLAIN SELECT 1"), ("UNKNOWN_SCHEMA", "SELECT * FROM OTHER.T"),
        ("FORBIDDEN_SCHEMA", "SELECT * FROM CONTROL.MERGES"), ("UNQUALIFIED_REFERENCE", "SELECT * FROM CUSTOMERS"), ("RESERVED_NAME", "SELECT * FROM GOLDEN.CUSTOMERS__ARCH_1"), ("DDL_ON_PRODUCTION", "DROP TABLE GOLDEN.CUSTOMERS"),
        ("WRITE_TO_READONLY", "DELETE FROM SOURCE_A.CUSTOMERS"), ("OTHER_BRANCH", "SELECT * FROM BR_00000000.T"), ("PARSE_ERROR", "SELEKT 1"), ("FORBIDDEN_SCHEMA", "SELECT * FROM GOLDEN.CUSTOMERS c, SYS.USERS u"),
        ("FORBIDDEN_SCHEMA", "SELECT (SELECT max(x) FROM CONTROL.T) FROM GOLDEN.CUSTOMERS"), ("DYNAMIC_TABLE", "SELECT * FROM range(10)"),
    ],
)
def test_refused_statements(spark, code, sql):
    with pytest.raises(StoreError) as e:
        retarget(spark, sql, BranchState("BR_AAAAAAAA"))
    assert e.value.code == code


def test_retarget_keeps_the_text(spark):
    state = BranchState("BR_A1", {"CUSTOMERS"})
    sql = "WITH t AS (SELECT ID FROM GOLDEN.CUSTOMERS WHERE N = 'FROM GOLDEN.X') -- note\nSELECT extract(YEAR FROM D) FROM t JOIN SOURCE_A.CUSTOMERS  s ON s.ID = t.ID"
    r = retarget(spark, sql, state)
    assert r.sql == sql.replace("FROM GOLDEN.CUSTOMERS", "FROM BR_A1__GOLDEN__CUSTOMERS").replace("SOURCE_A.CUSTOMERS", "PROD__SOURCE_A__CUSTOMERS")
    assert r.reads == ["GOLDEN.CUSTOMERS", "SOURCE_A.CUSTOMERS"] and r.writes == []


# store


def test_store_recovers_and_calls_once(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.create("GOLDEN.T", spark.range(3).toDF("ID"))
    s.write_version("GOLDEN.T", spark.range(5).toDF("ID"))
    assert len(s.recover()) == 1 and s.read("GOLDEN.T").count() == 3
    calls = []
    key = s.call_key("r", "tool", {"b": 1, "a": 2})
    assert key == s.call_key("r", "tool", {"a": 2, "b": 1})
    for _ in range(2):
        assert s.once(key, lambda: calls.append(1) or {"ok": True})["ok"]
    assert calls == [1]
    with pytest.raises(StoreError, match="BAD_NAME"):
        s.read("GOLDEN.T; DROP")


# keyless diff, rarity, browsing


def test_keyless_diff_counts_multisets(spark):
    base = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "K string, V string")
    head = spark.createDataFrame([("a", "1"), ("a", "9"), ("b", "3")], "K string, V string")
    assert tuple(diff.keyless_diff(base, head).first()) == (1, 1)
    assert tuple(diff.keyless_diff(base.limit(0), head).first()) == (3, 0)


def test_rare_columns_come_first(spark):
    d = spark.createDataFrame([("1", "CHANGED", 2), ("2", "CHANGED", 2), ("3", "CHANGED", 4), ("4", "ADDED", 0)], "key_value string, class string, cols_mask long")
    assert [r["key_value"] for r in diff.rarity_order(d, ["a", "b", "c"], 10).collect()] == ["3", "1", "2", "4"]


def test_needle_has_no_wildcards(spark):
    df = spark.createDataFrame([("50%",), ("500",), (None,)], "a string")
    assert [r["a"] for r in browse.page(df, needle="0%").collect()] == ["50%"]
    assert browse.page(df, limit=0).count() == 1


# linkage


def test_panel_of_father_and_son(spark):
    raw = "id string, full_name string, email string, phone string, addr_line string, city string, postcode string, dob date"
    d = datetime.date
    a = linkage.normalise(spark.createDataFrame([("A1", "John Smith", "j@x.example", "020 1234567", "1 High St", "Ely", "E1 1AA", d(1950, 1, 1)), ("A2", "", None, None, None, None, None, None)], raw))
    b = linkage.normalise(spark.createDataFrame([("B1", "John Smith Jr", None, "020 1234567", "1 High St", "Ely", "E1 1AA", d(1978, 5, 1)), ("B2", "Jon Smith", "J@X.EXAMPLE ", None, "1 High Street", "Ely", "e11aa", d(1950, 1, 1))], raw))
    pairs = linkage.candidates(list(linkage.standard_rules(a, b).values())[:5], "AB")
    p = {r["b_id"]: r for r in linkage.panel(linkage.weighted_score(linkage.signals(pairs, a, b))).collect()}
    assert p["B1"]["panel_result"] == "SPLIT" and p["B1"]["vote_skeptic"] == "REJECT" and p["B1"]["f_suffix"] == 1
    assert p["B2"]["panel_result"] == "UNANIMOUS_MERGE" and p["B2"]["s_email"] == 1000
    assert set(p) == {"B1", "B2"} and all(r["a_id"] == "A1" for r in p.values())


def test_groups_of_three_are_flagged_and_outage_leaves_splits(spark):
    v = spark.createDataFrame([("A1", "B1", "UNANIMOUS_MERGE"), ("A1", "B2", "UNANIMOUS_MERGE"), ("A3", "B3", "UNANIMOUS_MERGE"), ("A4", "B4", "SPLIT")], "a_id string, b_id string, panel_result string")
    out = {(r["a_id"], r["b_id"]): (r["verdict"], r["decision"]) for r in linkage.flag_clusters(linkage.verdicts(v)).collect()}
    assert out == {("A1", "B1"): ("FLAG", None), ("A1", "B2"): ("FLAG", None), ("A3", "B3"): ("MERGE", None), ("A4", "B4"): ("REJECT", "INSUFFICIENT_EVIDENCE")}


def test_synthetic_answer_is_found(spark):
    a, b, truth = synthetic.customers(spark, 2000)
    pairs = a.join(b, a.email == b.email_addr).selectExpr("cust_id as a_id", "client_ref as b_id")
    r = linkage.precision_recall(pairs, truth).first()
    assert (r["precision"], r["recall"]) == (1.0, 1.0)
    empty = linkage.precision_recall(pairs.limit(0), truth.limit(0)).first()
    assert empty["precision"] is None and empty["f1"] is None


# uploads


def test_delimited_file_is_sniffed_and_ragged_rows_kept(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_bytes("Ref;Name;Name;E-mail\n1;Müller, Jörg;x;j@x.de\n2;Ona;y\n\n3;Zoë;z;n/a;spare\n".encode("cp1252"))
    df, facts = delimited.read_delimited(spark, str(p))
    assert (facts["encoding"], facts["delimiter"], facts["header"]) == ("windows-1252", ";", ["Ref", "Name", "Name (2)", "E-mail"])
    assert [r["Name"] for r in df.orderBy("Ref").collect()] == ["Müller, Jörg", "Ona", "Zoë"]
    assert sum(r["__bad"] is not None for r in df.collect()) == 2


@pytest.mark.parametrize("raw", [b"", b"PK\x03\x04zzz", b"only\none\n", b"a,b\n"])
def test_unusable_files_are_refused(raw):
    with pytest.raises(delimited.FileError):
        delimited.sniff(raw)


def test_mapping_suggestion():
    m = delimited.suggest_mapping(["Client Ref", "Surname", "Forename", "Primary email addr", "Tel", "Born"], {"Born": "date", "Primary email addr": "email"})
    assert (m["id"], m["last_name"], m["first_name"], m["email"], m["phone"], m["dob"]) == ("Client Ref", "Surname", "Forename", "Primary email addr", "Tel", "Born")


def test_date_formats_and_upload_issues(spark):
    v = spark.createDataFrame([("03/04/1985",), ("05/06/1990",), (None,)], "v string")
    got = delimited.date_formats(v).collect()
    assert [r["format"] for r in got] == ["dd/MM/yyyy", "MM/dd/yyyy"] and all(r["ambiguous"] for r in got)
    assert delimited.date_formats(v.limit(0)).collect() == []
    up = spark.createDataFrame([("1", "a", "Smith, John", "bad", "12", "31/02/1990"), ("2", "a", None, "x@y.zz", "0123456", "01/01/1990"), ("3", None, "Z", None, None, None)], "line string, id string, full string, mail string, tel string, born string")
    loaded, issues = delimited.normalise_upload(up, {"id": "id", "full_name": "full", "email": "mail", "phone": "tel", "dob": "born"}, {"dob": "dd/MM/yyyy"}, "line", "A-")
    assert [(r["id"], r["full_name"], r["email"], r["phone"], r["dob"]) for r in loaded.collect()] == [("A-a", "John Smith", None, None, None)]
    assert {r["code"]: r["n"] for r in issues.collect()} == {"BAD_EMAIL": 1, "BAD_PHONE": 1, "BAD_DOB": 1, "DUPLICATE_ID": 1, "NO_NAME": 1, "MISSING_ID": 1}


# events


def test_stream_folds_like_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = lambda k, ts, b, **p: ev.emit(k, ts, "r", b, **p)
    op = dict(op_id=1, status="OK", rows_affected=1, tables_written=[], rationale="", sql="")
    opened = dict(defect_class="x", purpose="", schema="")
    first = [line("branch.opened", "01", "B1", **opened), line("branch.op", "02", "B1", **op), line("branch.opened", "03", "B2", **opened)]
    second = [line("branch.op", "04", "B1", **op), line("branch.discarded", "05", "B1", reason="x"), line("branch.op", "06", "B2", **op)]
    (log / "1.json").write_text("\n".join(first))
    (log / "2.json").write_text("\n".join(second))
    batch = {tuple(r) for r in ev.branch_states(ev.read_log(spark, str(log))).collect()}
    q = ev.stream_branch_states(spark.readStream.schema(ev.ENVELOPE).option("maxFilesPerTrigger", 1).json(str(log))).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("folded").orderBy("n_ops").collect():
        last[r["branch_id"]] = tuple(r)
    assert set(last.values()) == batch == {("B1", "DISCARDED", 2), ("B2", "OPEN", 1)}


def test_contract_of_events(spark):
    bad = spark.createDataFrame([("nope", "1", "r", None, "{}"), ("run.ended", "1", "r", None, "{}"), ("run.ended", "1", "r", None, "x"), ("run.ended", "1", "r", None, '{"status":"OK"}')], ev.ENVELOPE)
    assert [r["problem"] for r in ev.validated(bad).collect()] == ["unknown type nope", "missing status", "payload is no object", None]
    assert len(ev.json_schema()["oneOf"]) == 32


# mappings, blocking statements, plans, review


@pytest.mark.parametrize("text", ["", "(SELECT max(ID) FROM T)", "MOBILE FROM X", "upper(a), b", "T.a", "sleep(1)", "count(*) OVER ()", "a; b", "no_such_column"])
def test_hostile_mappings_are_refused(spark, text):
    with pytest.raises(StoreError, match="BAD_MAPPING"):
        playbook.check_expression(spark, text, spark.createDataFrame([("x", "y")], "a string, b string"))


def test_mapping_needs_all_fields(spark):
    b = spark.createDataFrame([("x",)], "a string")
    whole = {f: "upper(trim(a))" for f in playbook.REQUIRED}
    playbook.check_mapping(spark, whole, b)
    assert playbook.mapped(b, {"EMAIL": "CASE WHEN a IN ('x') THEN concat(a, 'z') END"}).first()["B_EMAIL"] == "xz"
    for bad in ({k: v for k, v in whole.items() if k != "EMAIL"}, whole | {"SALARY": "a"}):
        with pytest.raises(StoreError, match="BAD_MAPPING"):
            playbook.check_mapping(spark, bad, b)


def test_blocking_statements(spark):
    spark.createDataFrame([("A1", "x"), ("A2", "y"), (None, "x")], "CUST_ID string, E string").createOrReplaceTempView("SOURCE_A__CUSTOMERS")
    spark.createDataFrame([("B1", "x"), ("B1", "x")], "REF string, E string").createOrReplaceTempView("SOURCE_B__CLIENTS")
    ok = "SELECT a.CUST_ID AS A_ID, b.REF AS B_ID FROM SOURCE_A.CUSTOMERS a JOIN SOURCE_B.CLIENTS b ON a.E = b.E"
    assert rows(playbook.stage_candidates(spark, ok, "R")) == [("A1", "B1", "R")]
    for bad in ("DELETE FROM SOURCE_A.CUSTOMERS", "SELECT ID AS A_ID, ID AS B_ID FROM GOLDEN.CUSTOMERS", "SELECT CUST_ID AS A_ID FROM SOURCE_A.CUSTOMERS"):
        with pytest.raises(StoreError):
            playbook.stage_candidates(spark, bad, "R")


def test_recorded_plan_is_replayed(engine):
    plan = ['{"op": "open_branch", "branch": "one"}', '{"op": "run_in_branch", "branch": "one", "sql": "UPDATE GOLDEN.CUSTOMERS SET GRP = 7 WHERE ID = \'G0003\'"}', '{"op": "run_in_branch", "branch": "one", "sql": "COMMIT"}', '{"op": "request_merge", "branch": "one", "confidence": 0.9}']
    out = playbook.replay(engine, plan)
    assert [x.get("status") for x in out] == [None, "OK", "BLOCKED", "MERGED"] and out[-1]["applied"] == 1
    assert playbook.self_check(0.9, 5, 5) == 0.9 and playbook.self_check(0.9, 5, 4) == 0.7 and playbook.self_check(0.4, 1, 2) == 0.3


def test_matching_with_and_without_adjudicator(spark):
    raw = "id string, full_name string, email string, phone string, addr_line string, city string, postcode string, dob date"
    a = linkage.normalise(spark.createDataFrame([("A1", "John Smith", None, "020 1234567", "1 High St", "Ely", "E1", None)], raw))
    b = linkage.normalise(spark.createDataFrame([("B1", "John Smith Jr", None, "020 1234567", "1 High St", "Ely", "E1", None)], raw))
    staged = [linkage.standard_rules(a, b)["PHONE7"]]
    assert [r["verdict"] for r in playbook.run_matching(a, b, staged).collect()] == ["REJECT"]
    yes = playbook.run_matching(a, b, staged, lambda split: split.select("a_id", "b_id", F.lit("SAME_PERSON").alias("decision")))
    assert [(r["verdict"], r["match_class"]) for r in playbook.clone_matching(yes, "run2").collect()] == [("MERGE", "PHONE_ADDRESS")]


def test_review_of_cards_and_precedents(spark):
    cards = spark.createDataFrame([("1", "CHANGED", None, 2, True, 0.9), ("2", "DELETED", None, 2, True, 0.8), ("3", "CHANGED", "SPLIT", 2, False, 0.7), ("4", "CHANGED", None, 5, True, 0.6)], "key_value string, class string, panel_result string, component_size int, approved boolean, score_total double")
    assert [r["key_value"] for r in review.review_order(cards).collect()] == ["3", "4", "2", "1"]
    assert [r["key_value"] for r in review.filter_cards(cards, show="review").collect()] == ["3"]
    assert [r["key_value"] for r in review.filter_cards(cards, "delet", sort="score_desc").collect()] == ["2"]
    log = spark.createDataFrame([(1, "RECORD", "c", "v", None, 1), (1, "CITE", None, None, None, 2), (1, "NOTE", None, None, "n", 3), (2, "RECORD", "d", "w", None, 4), (2, "DELETE", None, None, None, 5)], "precedent_id int, action string, context string, verdict string, note string, at int")
    assert [tuple(r) for r in review.standing_precedents(log).select("precedent_id", "context", "note", "times_cited").collect()] == [(1, "c", "n", 1)]
    pairs = spark.createDataFrame([("k", "d")], "keep_golden_id string, drop_golden_id string")
    assert rows(review.closed_keys(spark.createDataFrame([("d",), ("x",)], "key_value string"), pairs)) == [("d",), ("k",), ("x",)]


# what a double, an id and a call are worth


def test_doubles_are_hashed_whole(spark):
    one = spark.createDataFrame([(1, 1.001), (2, 1e16), (3, float("nan")), (4, 0.1 + 0.2), (5, None)], "k int, v double")
    two = spark.createDataFrame([(1, 1.004), (2, 1e16), (3, float("nan")), (4, 0.3), (5, None)], "k int, v double")
    assert {r["key_value"]: r["cols_mask"] for r in keyed_diff(one, two, "k").collect()} == {"1": 2, "4": 2}
    assert keyed_diff(one, one, "k").count() == 0


def test_a_mask_refuses_columns_it_cannot_hold(spark):
    wide = spark.range(1).select("id", *[F.lit(1).alias(f"c{i}") for i in range(60)])
    with pytest.raises(ValueError, match="60 columns"):
        keyed_diff(wide, wide, "id")


def test_equal_ids_of_both_sources_are_two_records(spark):
    v = spark.createDataFrame([("2", "3", "UNANIMOUS_MERGE", "AB"), ("4", "2", "UNANIMOUS_MERGE", "AB"), ("5", "6", "UNANIMOUS_MERGE", "AA"), ("6", "9", "UNANIMOUS_MERGE", "AB")], "a_id string, b_id string, panel_result string, kind string")
    out = {(r["a_id"], r["b_id"]): r["verdict"] for r in linkage.flag_clusters(linkage.verdicts(v)).collect()}
    assert out == {("2", "3"): "MERGE", ("4", "2"): "MERGE", ("5", "6"): "FLAG", ("6", "9"): "FLAG"}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    import random

    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}") for _ in range(45)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)] + [(None, "z"), ("z", "z")]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, y in edges:
        if x and x != y:
            a, b = sorted((root(x), root(y)))
            up[b] = a
    groups = {x: root(x) for x in up}
    want = {(x, g, sum(h == g for h in groups.values())) for x, g in groups.items()}
    df = spark.createDataFrame(edges, "x string, y string")
    assert {tuple(r) for r in linkage.components(df).collect()} == want
    assert linkage.components(df.limit(0)).count() == 0


def test_an_undone_version_survives_recovery_and_inserts_are_counted(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.create("GOLDEN.T", spark.range(3).toDF("ID"))
    later = s.insert("GOLDEN.T", spark.range(5).toDF("ID"), 5)["version"]
    s.rollback("GOLDEN.T", 1)
    assert s.recover() == [] and s.read("GOLDEN.T", later).count() == 5
    with pytest.raises(StoreError, match="ROW_COUNT_MISMATCH"):
        s.insert("GOLDEN.T", spark.range(4).toDF("ID"), 5)
    assert s.read("GOLDEN.T").count() == 3
    assert s.reseed("GOLDEN.T", spark.range(7).toDF("ID")).n == 7
    s.log("ops", {"a": 1})
    s.log("precedents", {"a": 1})
    assert s.clear_run_state() == 1 and s.rows("precedents") and not s.rows("ops")


def test_two_callers_make_one_call(spark, tmp_path):
    import threading
    import time

    s, calls, got = Store(spark, str(tmp_path)), [], []
    slow = lambda: (time.sleep(0.3), calls.append(1), {"n": len(calls)})[2]
    both = [threading.Thread(target=lambda: got.append(s.once("k", slow))) for _ in range(2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert calls == [1] and sorted(x.get("replayed", False) for x in got) == [False, True] and {x["n"] for x in got} == {1}


def test_unapproved_rows_need_review_and_another_process_goes_on(spark, tmp_path):
    from tidemark.plans.branch import Engine

    s = Store(spark, str(tmp_path))
    s.create("GOLDEN.CUSTOMERS", spark.range(20).selectExpr("id as K", "'x' as V"), "K")
    refuse = lambda _, d: d.withColumn("approved", F.when(F.col("default_reason") == "DEFAULT", F.col("key_value") != "3").otherwise(F.col("approved"))).withColumn("default_reason", F.when((F.col("key_value") == "3") & (F.col("default_reason") == "DEFAULT"), "UNEXPLAINED").otherwise(F.col("default_reason")))
    e = Engine(spark, s, defaults=refuse, enrich=lambda _, c: c.withColumn("seen", F.lit(1)))
    b = e.open_branch("x")
    e.run(b, "UPDATE GOLDEN.CUSTOMERS SET V = 'y' WHERE K < 5")
    m = e.request_merge(b, 0.99)
    assert (m["status"], m["reason"], m["facts"]["needs_review"]) == ("PENDING", "ROWS_NEED_REVIEW", 1)
    assert not e.base_drift(b, "GOLDEN.CUSTOMERS") and e.cards(b, "GOLDEN.CUSTOMERS").where("seen = 1").count() == 5
    other = Engine(spark, s, defaults=refuse)
    assert [x["merge_id"] for x in other.pending()] == [1] and other.pending(run_id="no") == []
    other.set_approval(b, "GOLDEN.CUSTOMERS", ["3"], False)
    assert other.apply(1)["status"] == "MERGED" and s.read("GOLDEN.CUSTOMERS").where("V = 'y'").count() == 4
    assert Engine(spark, s).merges[0]["refused"] == 1
    assert other.pending() == [] and len(other.pending(include_resolved=True)) == 1
    c = other.open_branch("y")
    other.run(c, "UPDATE GOLDEN.CUSTOMERS SET V = 'z' WHERE K = 9")
    first, again = (other.request_merge(c, 0.99, call="r1") for _ in range(2))
    assert again["replayed"] and first["merge_id"] == again["merge_id"] == 2 and len(other.merges) == 2


def test_rows_are_numbered_by_ranges(spark):
    from tidemark.sources.delimited import numbered

    df = spark.range(1000).selectExpr("id * 7 % 1000 as o", "id as v").repartition(5)
    assert [r["n"] for r in numbered(df, "o", "n").orderBy("o").collect()] == list(range(1, 1001))
    assert numbered(df.limit(0), "o", "n").count() == 0


def test_exports_and_labels(spark, tmp_path):
    from tidemark.functions import labels
    from tidemark.operators import browse, export

    df = spark.createDataFrame([(1, True, "a,b", None), (2, None, 'q"', datetime.datetime(2026, 1, 2, 3, 4, 5))], "k int, ok boolean, t string, at timestamp_ntz")
    assert "".join(export.csv_chunks(df, 1)) == '\ufeffk,ok,t,at\r\n1,yes,"a,b",\r\n2,,"q""",2026-01-02T03:04:05\r\n'
    assert "".join(export.csv_chunks(df.limit(0))) == "\ufeffk,ok,t,at\r\n"
    assert export.dataset({"x": df}, str(tmp_path)) and spark.read.option("header", True).csv(f"{tmp_path}/x").count() == 2
    got = spark.createDataFrame([(0.0, 0), (10.0, 1), (100.0, 2), (None, None)], "s double, n int").select(labels.risk(F.col("s")).alias("r"), labels.chip(F.col("n"), "row").alias("c")).collect()
    assert [tuple(r) for r in got] == [("none", ""), ("low", "1 row"), ("medium", "2 rows"), (None, "")]
    same = spark.createDataFrame([("A@x ", "a@X", "+44 20 7946 0018", "020 7946 0018")], "a string, b string, p string, q string")
    assert tuple(same.select(labels.same_field("email", F.col("a"), F.col("b")), labels.same_field("text", F.col("p"), F.col("q"))).first()) == (True, False)
    assert browse.filtered(df, k=1, t=None).count() == 1


def test_crowded_buckets_are_made_finer(spark, monkeypatch):
    from tidemark.operators import checksum_diff as module

    asked = []
    whole = module.unequal_buckets
    monkeypatch.setattr(module, "unequal_buckets", lambda *a: asked.append(a[-1]) or whole(*a))
    one = spark.range(4000).selectExpr("id as k", "'x' as same", "id % 7 as v")
    two = one.withColumn("v", F.when(F.col("k") % 20 == 0, F.lit(99)).otherwise(F.col("v"))).where("k <> 5")
    got = {(r["key_value"], r["class"], r["cols_mask"]) for r in module.checksum_diff(one, two, "k", buckets=64).collect()}
    assert got == {(str(k), "CHANGED", 4) for k in range(0, 4000, 20)} | {("5", "DELETED", 7)}
    assert asked[0] == 64 and 512 <= asked[1] <= 2048


def test_dirty_dataset_and_its_score(spark):
    from tidemark.operators.score import score

    d = synthetic.dataset(spark, 3000)
    assert d["a"].groupBy("cust_id").count().where("count > 1").count() == 0 and d["true_dups"].count() > 30 and d["true_pairs"].where("is_decoy").count() > 40
    assert d["true_pairs"].join(d["b"], d["true_pairs"].b_id == d["b"].client_ref, "left_anti").count() == 0
    merged = d["true_pairs"].select(F.lit("AB").alias("kind"), "a_id", "b_id", F.lit("MERGE").alias("verdict"))
    golden = d["true_pairs"].select(F.col("a_id").alias("source_a_ref"), F.col("b_id").alias("source_b_ref"), F.lit(None).cast("string").alias("merged_a_refs"))
    r = score(merged, golden, d["true_pairs"], d["true_dups"]).first()
    decoys = d["true_pairs"].where("is_decoy").count()
    assert r["fp"] == r["decoys_merged"] == r["decoy_false_merges"] == r["false_merges_ab"] == decoys and r["fn"] == 0 and r["recall"] == 1.0
    none = score(merged.limit(0), golden.limit(0), d["true_pairs"], d["true_dups"]).first()
    assert (none["precision"], none["recall"], none["f1"], none["flagged_pairs"]) == (0.0, 0.0, 0.0, 0)


def test_ragged_blank_and_limited_files(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("id,name\n1,a\n\n2\n3,b,c\n4,d\x00\n")
    rows, facts = delimited.read_delimited(spark, str(p))
    assert {k: facts[k] for k in ("rows", "ragged", "blank")} == {"rows": 4, "ragged": 2, "blank": 1}
    assert [(r["id"], r["name"]) for r in rows.orderBy("id").collect()] == [("1", "a"), ("2", None), ("3", "b"), ("4", "d")]
    for limits in ({"max_bytes": 10}, {"max_rows": 3}):
        with pytest.raises(delimited.FileError):
            delimited.read_delimited(spark, str(p), **limits)


def test_a_failing_sink_breaks_no_other(spark):
    got = []
    sink = ev.fan_out(lambda df, i: 1 / 0, lambda df, i: got.append(df.count()))
    sink(spark.range(3), 7)
    assert got == [3] and sink.failures[0][:2] == (7, 0)
    log = spark.createDataFrame([("agent.note", "2", "r", None, '{"text": "hello"}'), ("db.snapshot", "3", "r", None, "{}")], ev.ENVELOPE)
    assert [tuple(r) for r in ev.narrative(log).collect()] == [("2", None, "agent.note hello")]
