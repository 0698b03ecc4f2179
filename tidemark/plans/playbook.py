"""Declared mappings, blocking statements and recorded plans: what an agent may say, checked before it runs."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import linkage
from tidemark.plans.branch import Engine
from tidemark.plans.retarget import READ_ONLY, scan, statement_kind, table_names
from tidemark.store import StoreError

#: Golden fields that a mapping must give, the optional one, and the functions it may call.
REQUIRED, OPTIONAL = ("FULL_NAME", "EMAIL", "PHONE", "ADDR_LINE", "CITY", "POSTCODE", "COUNTRY", "DATE_OF_BIRTH"), ("LAST_SEEN",)
FUNCTIONS = frozenset("TRIM LTRIM RTRIM UPPER LOWER TO_DATE TRY_TO_DATE CONCAT CONCAT_WS REPLACE REGEXP_REPLACE SUBSTR SUBSTRING COALESCE NVL NULLIF INITCAP CAST TO_CHAR LENGTH RIGHT LEFT".split())
_NOT_SCALAR = frozenset("SELECT FROM WHERE GROUP ORDER HAVING UNION JOIN LIMIT OVER EXISTS WITH".split())
#: The classes in the order they are merged, and how sure each is.
CLASSES = (("EXACT_EMAIL", 0.99), ("PHONE_ADDRESS", 0.97), ("NEW_CUSTOMERS", 0.98), ("INTERNAL_DEDUP", 0.90), ("FUZZY_NAME", 0.80))


def check_expression(spark: SparkSession, text: str, source: DataFrame) -> None:
    """Refuses anything but one scalar over the source's own columns and allowed functions."""
    tokens = scan(text)
    if not tokens:
        raise StoreError("BAD_MAPPING", "empty expression")
    for i, t in enumerate(tokens):
        if t.kind == "word" and t.upper in _NOT_SCALAR:
            raise StoreError("BAD_MAPPING", f"{t.text} is not part of a scalar")
        if t.text in (";", ".") and t.kind == "symbol":
            raise StoreError("BAD_MAPPING", "only unqualified columns and plain calls")
        if t.kind == "word" and i + 1 < len(tokens) and tokens[i + 1].text == "(" and t.upper not in FUNCTIONS | {"IN", "AND", "OR", "NOT", "WHEN", "THEN", "ELSE", "AS", "DECIMAL", "VARCHAR", "CHAR"}:
            raise StoreError("BAD_MAPPING", f"function {t.text} is not allowed")
    try:
        if len(source.limit(0).select(F.expr(text).alias("x")).columns) != 1:
            raise StoreError("BAD_MAPPING", "more than one value")
    except StoreError:
        raise
    except Exception as e:
        raise StoreError("BAD_MAPPING", str(e).splitlines()[0][:200]) from None


def check_mapping(spark: SparkSession, mapping: dict[str, str], source: DataFrame) -> None:
    """Every required field once, nothing unknown, every expression a scalar."""
    if missing := [f for f in REQUIRED if f not in mapping]:
        raise StoreError("BAD_MAPPING", "missing " + ",".join(missing))
    if unknown := [f for f in mapping if f not in REQUIRED + OPTIONAL]:
        raise StoreError("BAD_MAPPING", "unknown " + ",".join(unknown))
    for text in mapping.values():
        check_expression(spark, text, source)


def mapped(source: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The source with a column B_<field> for each mapped field."""
    return source.select("*", *[F.expr(e).alias(f"B_{f}") for f, e in mapping.items()])


def stage_candidates(spark: SparkSession, sql: str, rule: str, kind: str = "AB") -> DataFrame:
    """(a_id, b_id, rule) of a blocking statement over the sources' temporary views SCHEMA__TABLE.

    Only a query that reads source schemas and gives exactly A_ID and B_ID passes; pairs with missing ids, and in AA
    records paired with themselves, are left out.
    """
    if statement_kind(spark, sql) != "SELECT":
        raise StoreError("BAD_BLOCKING", "not a query")
    text = sql
    for start, end, schema, table, _ in sorted(table_names(scan(sql)), reverse=True):
        if schema not in READ_ONLY:
            raise StoreError("BAD_BLOCKING", f"reads {schema}.{table}")
        text = f"{text[:start]}{schema}__{table}{text[end:]}"
    df = spark.sql(text)
    if [c.upper() for c in df.columns] != ["A_ID", "B_ID"]:
        raise StoreError("BAD_BLOCKING", "the output must be A_ID, B_ID")
    pairs = df.toDF("a_id", "b_id").distinct().where("a_id is not null and b_id is not null")
    return (pairs.where("a_id <> b_id") if kind == "AA" else pairs).withColumn("rule", F.lit(rule))


def run_matching(a: DataFrame, b: DataFrame, staged: list[DataFrame], adjudicate=None) -> DataFrame:
    """Candidates to classes: score, vote, adjudicate split pairs if there is someone to, close, classify.

    ``adjudicate`` takes the split pairs and gives (a_id, b_id, decision); without it, or where it fails, they are left
    to people.
    """
    votes = linkage.panel(linkage.weighted_score(linkage.signals(linkage.candidates(staged, "AB"), a, b)))
    said = adjudicate(linkage.summary(votes.where("panel_result = 'SPLIT'"))) if adjudicate else None
    return linkage.match_class(linkage.flag_clusters(linkage.verdicts(votes, said)))


def clone_matching(decided: DataFrame, run_id: str) -> DataFrame:
    """The same decisions under another run, so that two policies are compared on nothing but themselves."""
    return decided.withColumn("run_id", F.lit(run_id))


def self_check(confidence: float, expected: int, observed: int) -> float:
    """Less sure by 0.2, not below 0.3, where a branch changed another number of rows than planned."""
    return confidence if expected == observed else max(0.3, round(confidence - 0.2, 4))


def replay(engine: Engine, plan: Iterable[str | dict]) -> list[dict]:
    """Run a recorded plan: JSON lines {"op": ..., "branch": name, ...}; branch names stand for the new ids."""
    ids: dict[str, str] = {}
    out = []
    for line in plan:
        step = json.loads(line) if isinstance(line, str) else dict(line)
        op, name = step["op"], step.get("branch", "")
        try:
            if op == "open_branch":
                ids[name] = engine.open_branch(step.get("purpose", ""))
                result = {"branch_id": ids[name]}
            elif op == "run_in_branch":
                engine.run(ids[name], step["sql"].replace(name, ids[name]) if name.startswith("BR_") else step["sql"])
                result = {"status": "OK"}
            elif op == "request_merge":
                m = engine.request_merge(ids[name], step["confidence"], step.get("tier", 2), step.get("gate_enabled", True))
                result = {k: m.get(k) for k in ("merge_id", "status", "reason", "applied", "refused")}
            elif op == "discard_branch":
                engine.discard(ids[name])
                result = {"status": "DISCARDED"}
            else:
                raise StoreError("UNKNOWN_OP", op)
        except StoreError as e:
            result = {"status": "BLOCKED", "error": str(e)}
        out.append({"op": op, "branch": name} | result)
    return out
