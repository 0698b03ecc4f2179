"""The event log: its contract, batch and streaming folds, windows and expiry."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

ENVELOPE = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "ts", "run_id", "branch_id", "payload")])
#: Event types and the payload keys each must have.
REQUIRED = {
    "run.started": "tier gate_enabled mode seed min_confidence", "run.ended": "status", "agent.note": "text", "profile.found": "source table finding", "mapping.declared": "mapping",
    "hypothesis.stated": "match_class expected_count rationale", "candidates.ready": "kind possible_pairs candidates reduction_ratio per_rule ms", "panel.voted": "unanimous_merge split unanimous_reject per_class",
    "adjudicating": "pairs adjudicator", "adjudicated": "pairs adjudicator verdicts latency_ms", "precedent.cited": "pair_id precedent_ids verdict", "precedent.recorded": "precedent_id verdict defect_class",
    "cluster.flagged": "components largest pairs_flagged", "branch.opened": "defect_class purpose schema", "branch.materialised": "table rows copy_ms base_fingerprint key_mode",
    "branch.op": "op_id status rows_affected tables_written rationale sql", "branch.blocked": "code message sql", "selfcheck": "expected observed discrepancy confidence_before confidence_after note",
    "diff.computed": "table mode added changed deleted unchanged columns_touched column_order rows rows_total base_drifted diff_ms", "merge.requested": "merge_id confidence rationale total_changed",
    "merge.gated": "merge_id decision reason risk tier limits rows_needing_review", "rows.deselected": "keys approved approved_count total",
    "merge.applied": "merge_id rows_applied rows_excluded stage_ms swap_ms pre_fingerprint post_fingerprint", "merge.rejected": "merge_id code", "branch.discarded": "reason", "branch.expired": "age_seconds",
    "unmerge.applied": "merge_id fingerprint_match restored_fingerprint expected_fingerprint", "policy.adapted": "min_confidence_before min_confidence_after reason",
    "score.updated": "precision recall f1 false_merges_in_golden decoy_false_merges", "golden.fingerprint": "table fingerprint rows",
    "dataset.activated": "name label rows_a rows_b golden_rows scored", "db.snapshot": "db_time session version tables columns keys config ms trigger",
}
#: What an event makes of its branch.
STATUS = {"branch.opened": "OPEN", "branch.discarded": "DISCARDED", "branch.expired": "EXPIRED", "merge.applied": "MERGED", "merge.rejected": "BLOCKED", "unmerge.applied": "UNMERGED"}


def problem(kind: Column, payload: Column) -> Column:
    """Why an event breaks the contract; null if it doesn't."""
    keys = F.json_object_keys(payload)
    need = F.create_map(*[x for t, ks in REQUIRED.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in ks.split()]))])
    wanted = F.try_element_at(need, kind)
    missing = F.array_except(wanted, F.coalesce(keys, F.array().cast("array<string>")))
    return F.when(wanted.isNull(), F.concat(F.lit("unknown type "), F.coalesce(kind, F.lit("?")))).when(keys.isNull(), "payload is no object").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.concat_ws(",", missing)))


def validated(events: DataFrame) -> DataFrame:
    """Events with the column ``problem``; works on batches and streams alike."""
    return events.withColumn("problem", problem(F.col("type"), F.col("payload")))


def read_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A JSON-lines log, all of it or as it grows."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ENVELOPE).json(path)


def json_schema() -> dict:
    """The contract as JSON Schema."""
    one = lambda t, ks: {"properties": {"type": {"const": t}, "payload": {"type": "object", "required": ks.split()}}, "required": ["type", "ts", "run_id", "branch_id", "payload"]}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "oneOf": [one(t, ks) for t, ks in REQUIRED.items()]}


def fold(events: DataFrame, key: str, order: list[str], kind: str = "type") -> DataFrame:
    """(key, n, last_kind, last_at): the state of each key after all its events, by aggregates that combine map-side."""
    at = F.struct(*order)
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max_by(kind, at).alias("last_kind"), F.max(order[0]).alias("last_at"))


def branch_states(events: DataFrame) -> DataFrame:
    """(branch_id, status, n_ops) from the log, in batch."""
    marks = events.withColumn("status", F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("type")))
    return marks.where("branch_id is not null").groupBy("branch_id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("ts"))).alias("status"), F.count(F.when(F.col("type") == "branch.op", 1)).alias("n_ops"))


def stream_branch_states(events: DataFrame) -> DataFrame:
    """The same fold as a stateful stream: one update of (branch_id, status, n_ops) for each branch and trigger."""
    out = "branch_id string, status string, n_ops long"
    state = "at string, status string, n_ops long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        at, status, n = held.get if held.exists else ("", None, 0)
        for df in batches:
            for t, ts in zip(df["type"], df["ts"]):
                n += t == "branch.op"
                if t in STATUS and ts >= at:
                    at, status = ts, STATUS[t]
        held.update((at, status, n))
        yield pd.DataFrame({"branch_id": [key[0]], "status": [status], "n_ops": [n]})

    return events.where("branch_id is not null").groupBy("branch_id").applyInPandasWithState(step, out, state, "update", "NoTimeout")


def append_jsonl(path: str):
    """A sink for ``foreachBatch`` that appends each batch to a folder of JSON lines; what was written stays."""

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").json(f"{path}/batch={batch_id}")  # a repeated batch replaces itself

    return sink


def sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(user, started, ended, n) of runs of events no further apart than the gap."""
    return events.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def tumbling(events: DataFrame, at: str = "ts", width: str = "1 hour", value: str = "value") -> DataFrame:
    return events.groupBy(F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("started"), "n", "total")


def expired(opened: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Rows(key, at) that have been open longer than ``ttl`` seconds."""
    return opened.where(F.timestamp_diff("SECOND", F.col("at"), now) > ttl)


def recent(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n events, a top-n that never sorts the whole log."""
    return events.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def numbered(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    return events.withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def emit(kind: str, ts: str, run_id: str, branch_id: str | None, **payload) -> str:
    """A line of the log; raises on a payload that breaks the contract."""
    missing = [k for k in REQUIRED[kind].split() if k not in payload]
    if missing:
        raise ValueError(f"{kind}: missing {missing}")
    return json.dumps({"type": kind, "ts": ts, "run_id": run_id, "branch_id": branch_id, "payload": json.dumps(payload)})


def _field(name: str, kind: str = "string") -> Column:
    return F.get_json_object("payload", f"$.{name}").cast(kind)


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, mode, tier, gate_enabled, min_confidence, started, status, ended) of every run: how it began, the policy it
    came to, and how it ended."""
    of = lambda kind, value: F.max_by(value, F.when(F.col("type") == kind, F.col("ts")))
    policy = F.coalesce(F.when(F.col("type") == "run.started", _field("min_confidence", "double")), F.when(F.col("type") == "policy.adapted", _field("min_confidence_after", "double")))
    return events.where("run_id is not null").groupBy("run_id").agg(
        of("run.started", _field("mode")).alias("mode"), of("run.started", _field("tier", "int")).alias("tier"), of("run.started", _field("gate_enabled", "boolean")).alias("gate_enabled"),
        F.max_by(policy, F.when(policy.isNotNull(), F.col("ts"))).alias("min_confidence"), F.min(F.when(F.col("type") == "run.started", F.col("ts"))).alias("started"),
        of("run.ended", _field("status")).alias("status"), F.max(F.when(F.col("type") == "run.ended", F.col("ts"))).alias("ended"),
    )


def golden_history(events: DataFrame) -> DataFrame:
    """(table, ts, fingerprint, cause): every observed fingerprint of a table; a merge where it differs from the one before."""
    seen = events.where("type = 'golden.fingerprint'").select(_field("table").alias("table"), "ts", _field("fingerprint").alias("fingerprint"))
    before = F.lag("fingerprint").over(W.partitionBy("table").orderBy("ts", "fingerprint"))
    return seen.withColumn("cause", F.when(before.isNotNull() & (before != F.col("fingerprint")), "merge").otherwise("observed"))


def narrative(events: DataFrame, n: int = 40) -> DataFrame:
    """(ts, branch_id, text): the last n events in words."""
    said = F.coalesce(_field("text"), _field("finding"), _field("rationale"), _field("message"), _field("reason"), _field("status"), _field("decision"), F.lit(""))
    return recent(events.where("type <> 'db.snapshot'"), n, ["ts"]).select("ts", "branch_id", F.trim(F.concat_ws(" ", "type", said)).alias("text"))


def throttled(events: DataFrame, at: str = "ts", width: str = "800 milliseconds") -> DataFrame:
    """The newest event of every stretch of time: a snapshot follows events at most that often.  For batches and streams."""
    return events.groupBy(F.window(at, width).alias("w")).agg(F.max(F.struct(at, *[c for c in events.columns if c != at])).alias("e")).select("e.*")


def fan_out(*sinks):
    """One sink for ``foreachBatch`` out of several; one that fails keeps no other from its batch.  Returns the sink; its
    ``failures`` lists (batch, number of the sink, error)."""

    def sink(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            for i, one in enumerate(sinks):
                try:
                    one(df, batch_id)
                except Exception as e:  # a sink must not break its neighbours
                    sink.failures.append((batch_id, i, str(e)[:300]))
        finally:
            df.unpersist()

    sink.failures = []
    return sink
