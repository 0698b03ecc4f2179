"""Branches of governed tables and the change-sets that come of them.

A branch pins the version it was opened on, which costs nothing, since versions are immutable.  Each statement writes the
next state of the branch's copy as a version of its own, so lineage never grows.  A change-set is the exact difference;
the gate decides on it; applying it stages the approved rows, checks the staged fingerprint against the one computed from
the hashes alone, and replaces the pointer.  Undoing goes in order of application, newest first.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.hashing import Fingerprint, fingerprint, signature
from tidemark.operators import gate
from tidemark.operators.diff import drifted_keys, keyed_diff, keyless_diff, rarity_order, sample_values, with_decisions
from tidemark.operators.merge import expected_fingerprint, stage
from tidemark.plans.dml import next_state
from tidemark.plans.retarget import BranchState, Retargeted, retarget, view_name
from tidemark.store import Store, StoreError

MAX_OPEN, TTL_SECONDS, MAX_ROWS = 8, 1800, 5_000_000_000


class Engine:
    """Branches, change-sets and undo over a store; ``clock`` gives seconds, so that tests can set it."""

    def __init__(self, spark: SparkSession, store: Store, clock: Callable[[], float] = time.time, defaults: Callable[[str, DataFrame], DataFrame] | None = None, enrich: Callable[[str, DataFrame], DataFrame] | None = None):
        """``defaults(branch_id, diff)`` decides rows nobody has decided, ``enrich(branch_id, cards)`` adds to review cards.

        What branches and change-sets have come to is kept in the store, so another process goes on where one ended.
        """
        self.spark, self.store, self.clock, self.defaults, self.enrich = spark, store, clock, defaults, enrich
        self._file = store.root / "_control.json"
        kept = json.loads(self._file.read_text()) if self._file.exists() else {}
        self.branches: dict[str, dict] = kept.get("branches", {})
        self.merges: list[dict] = kept.get("merges", [])
        self.min_confidence: float = kept.get("min_confidence", 0.0)
        self._sequence: int = kept.get("sequence", 0)

    def _save(self) -> None:
        tmp = self._file.with_suffix(".tmp")
        tmp.write_text(json.dumps({"branches": self.branches, "merges": self.merges, "min_confidence": self.min_confidence, "sequence": self._sequence}, default=str))
        os.replace(tmp, self._file)

    # branches
    def open_branch(self, purpose: str = "", run_id: str = "run") -> str:
        if sum(b["status"] == "OPEN" and b["run_id"] == run_id for b in self.branches.values()) >= MAX_OPEN:
            raise StoreError("TOO_MANY_BRANCHES")
        branch_id = f"BR_{uuid.uuid4().hex[:8].upper()}"
        self.branches[branch_id] = {"run_id": run_id, "purpose": purpose, "status": "OPEN", "opened": self.clock(), "base": {}, "head": {}, "created": {}, "ops": [], "errors": 0, "decisions": {}}
        self._save()
        return branch_id

    def _open(self, branch_id: str) -> dict:
        b = self.branches.get(branch_id)
        if b is None:
            raise StoreError("NO_SUCH_BRANCH", branch_id)
        if b["status"] != "OPEN":
            raise StoreError("BRANCH_NOT_OPEN", b["status"])
        return b

    def _materialise(self, b: dict, table: str) -> None:
        if not self.store.exists(table):
            raise StoreError("NO_DIFF_KEY_REGISTERED", table)
        p = self.store.pointer(table)
        if int(p["fingerprint"][0]) > MAX_ROWS:
            raise StoreError("TABLE_TOO_LARGE_TO_BRANCH", table)
        df = self.store.read(table, p["version"])
        key = p["key"]
        if key:
            n = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("k"), F.count_distinct(key).alias("d")).first()
            key = key if n["n"] == n["k"] == n["d"] else None
        b["base"][table] = {"version": p["version"], "key": key, "signature": p["signature"], "rows": int(p["fingerprint"][0])}
        b["head"][table] = ("prod", p["version"])

    def _read_head(self, b: dict, table: str) -> DataFrame:
        where, at = b["head"][table]
        return self.store.read(table, at) if where == "prod" else self.spark.read.parquet(at)

    def _register(self, branch_id: str, b: dict) -> None:
        for name in self.store.tables():
            schema, table = name.split(".")
            self.store.read(name).createOrReplaceTempView(view_name("PROD", schema, table))
        for name in b["head"]:
            schema, table = name.split(".")
            self._read_head(b, name).createOrReplaceTempView(view_name(branch_id, schema, table))
        for table, path in b["created"].items():
            self.spark.read.parquet(path).createOrReplaceTempView(view_name(branch_id, branch_id, table))

    def run(self, branch_id: str, sql: str, rationale: str = "") -> DataFrame | None:
        """Run one statement in a branch; the rows of a query, nothing for a change."""
        b = self._open(branch_id)
        op = {"sql": sql, "rationale": rationale, "at": self.clock()}
        b["ops"].append(op)
        try:
            r = retarget(self.spark, sql, BranchState(branch_id, {t.split(".")[1] for t in b["head"]}, set(b["created"])))
            for table in r.to_materialise:
                self._materialise(b, table)
            self._register(branch_id, b)
            out = self._execute(branch_id, b, r)
            op |= {"status": "OK", "kind": r.kind, "reads": r.reads, "writes": r.writes}
            return out
        except StoreError as e:
            op |= {"status": "BLOCKED", "error": str(e)}
            raise
        except Exception as e:
            b["errors"] += 1
            op |= {"status": "ERROR", "error": str(e)[:500]}
            raise
        finally:
            self._save()

    def _execute(self, branch_id: str, b: dict, r: Retargeted) -> DataFrame | None:
        if r.kind == "SELECT":
            return self.spark.sql(r.sql)
        path = f"{self.store.root}/_branches/{branch_id}/{uuid.uuid4().hex[:12]}"
        if r.kind == "CTAS":
            table = r.writes[0].split(".")[1]
            query = r.sql[r.sql.upper().index(" AS ") + 4 :]
            self.spark.sql(query).write.parquet(path)
            b["created"][table] = path
            return None
        if r.kind == "DROP":
            b["created"].pop(r.writes[0].split(".")[1], None)
            return None
        target = r.writes[0]
        own = target.split(".")[0] == branch_id
        table = target.split(".")[1]
        columns = (self.spark.read.parquet(b["created"][table]) if own and table in b["created"] else self._read_head(b, target if not own else f"GOLDEN.{table}")).columns
        _, after = next_state(self.spark, r.sql, r.kind, columns)
        after.write.parquet(path)
        if own and table in b["created"]:
            b["created"][table] = path
        else:
            b["head"][target if not own else f"GOLDEN.{table}"] = ("branch", path)
        return None

    def acknowledge_errors(self, branch_id: str) -> int:
        b = self._open(branch_id)
        n, b["errors"] = b["errors"], 0
        self._save()
        return n

    def discard(self, branch_id: str, status: str = "DISCARDED") -> None:
        b = self._open(branch_id)
        b["status"] = status
        for m in self.merges:
            if m["branch_id"] == branch_id and m["status"] == "PENDING":
                m["status"] = "BLOCKED"
        self._save()

    def sweep(self) -> list[str]:
        """Expire branches that have been open too long; one that waits for a decision never expires."""
        waiting = {m["branch_id"] for m in self.merges if m["status"] == "PENDING"}
        old = [i for i, b in self.branches.items() if b["status"] == "OPEN" and i not in waiting and self.clock() - b["opened"] > TTL_SECONDS]
        for i in old:
            self.discard(i, "EXPIRED")
        return old

    # differences
    def diff(self, branch_id: str, table: str) -> DataFrame:
        """The branch's change-set of a keyed table, human decisions included."""
        b = self._open(branch_id)
        base = b["base"][table]
        if base["key"] is None:
            raise StoreError("KEYLESS", table)
        d = keyed_diff(self.store.read(table, base["version"]), self._read_head(b, table), base["key"])
        own = self.spark.createDataFrame(list(b["decisions"].get(table, {}).items()), "key_value string, approved boolean")
        out = with_decisions(d, own)
        return self.defaults(branch_id, out) if self.defaults else out

    def base_drift(self, branch_id: str, table: str) -> bool:
        """Whether the table as a whole has moved since the branch was opened; for information, it blocks nothing."""
        then = self._open(branch_id)["base"][table]["version"]
        return str(self.store.fingerprint(table)) != str(fingerprint(self.store.read(table, then)))

    def cards(self, branch_id: str, table: str, limit: int = 400) -> DataFrame:
        """The rows a reviewer sees first, with both versions of each, and what ``enrich`` knows of them."""
        b = self._open(branch_id)
        base, head = self.store.read(table, b["base"][table]["version"]), self._read_head(b, table)
        d = self.diff(branch_id, table)
        first = rarity_order(d, base.columns, limit).join(d.select("key_value", "approved", "default_reason"), "key_value")
        out = sample_values(first, base, head, b["base"][table]["key"])
        return self.enrich(branch_id, out) if self.enrich else out

    def pending(self, include_resolved: bool = False, run_id: str | None = None) -> list[dict]:
        """Change-sets that wait for a decision, oldest first; on request also those that have one, or of one run only."""
        return [m for m in self.merges if (include_resolved or m["status"] == "PENDING") and (run_id is None or self.branches[m["branch_id"]]["run_id"] == run_id)]

    def keyless_counts(self, branch_id: str, table: str) -> tuple[int, int]:
        b = self._open(branch_id)
        r = keyless_diff(self.store.read(table, b["base"][table]["version"]), self._read_head(b, table)).first()
        return int(r["added"]), int(r["deleted"])

    def set_approval(self, branch_id: str, table: str, keys: list[str], approved: bool) -> None:
        self._open(branch_id)["decisions"].setdefault(table, {}).update({k: approved for k in keys})
        self._save()

    # change-sets
    def _facts(self, branch_id: str, table: str, confidence: float) -> tuple[dict, DataFrame]:
        b = self._open(branch_id)
        base, current = b["base"][table], self.store.read(table)
        blocks = ["MULTI_TABLE"] if len(b["head"]) > 1 else []
        if b["errors"]:
            blocks.append("UNACKNOWLEDGED_ERRORS")
        if signature(current) != base["signature"]:
            blocks.append("SCHEMA_CHANGED")
        d = self.diff(branch_id, table)
        n = d.agg(*[F.count(F.when(F.col("class") == c, 1)).alias(c.lower()) for c in ("ADDED", "CHANGED", "DELETED")], F.count(F.when(~F.col("approved") & (F.col("default_reason") != "HUMAN"), 1)).alias("needs_review")).first()
        if self.store.pointer(table)["version"] != base["version"] and drifted_keys(d, self.store.read(table, base["version"]), current, base["key"]).limit(1).count():
            blocks.append("BASE_DRIFT")
        return {"added": n["added"], "changed": n["changed"], "deleted": n["deleted"], "table_rows": base["rows"], "needs_review": n["needs_review"], "hard_blocks": ",".join(blocks), "confidence": float(confidence)}, d

    def request_merge(self, branch_id: str, confidence: float, tier: int = 2, gate_enabled: bool = True, call: str | None = None) -> dict:
        """Decide on a branch's change-set and apply it where the gate allows.  ``call`` names a request that, whoever
        repeats it, is made once."""
        if call:
            key = self.store.call_key(call, "request_merge", {"branch_id": branch_id, "confidence": confidence, "tier": tier})
            return self.store.once(key, lambda: self.request_merge(branch_id, confidence, tier, gate_enabled))
        b = self._open(branch_id)
        if not b["head"]:
            raise StoreError("NO_DIFF", branch_id)
        table = next(iter(b["head"]))
        facts, _ = self._facts(branch_id, table, confidence)
        schema = "added long, changed long, deleted long, table_rows long, needs_review long, hard_blocks string, confidence double"
        r = gate.decide(self.spark.createDataFrame([tuple(facts.values())], schema), gate.TIERS[tier], gate_enabled, self.min_confidence).first()
        m = {"merge_id": len(self.merges) + 1, "branch_id": branch_id, "table": table, "status": {"MERGE": "APPLYING"}.get(r["decision"], r["decision"]), "decision": r["decision"], "reason": r["reason"], "risk": r["risk"], "facts": facts, "unmerged_at": None, "resolved_at": None}
        self.merges.append(m)
        self._save()
        return self.apply(m["merge_id"]) if r["decision"] == "MERGE" else m

    def apply(self, merge_id: int) -> dict:
        """Re-diff, re-check, stage, verify, swap."""
        try:
            return self._apply(merge_id)
        finally:
            self._save()

    def _apply(self, merge_id: int) -> dict:
        m = self.merges[merge_id - 1]
        if m["status"] not in ("PENDING", "APPLYING"):
            raise StoreError("MERGE_NOT_PENDING", m["status"])
        b, table = self._open(m["branch_id"]), m["table"]
        with self.store.lock():
            facts, d = self._facts(m["branch_id"], table, m["facts"]["confidence"])
            if facts["hard_blocks"]:
                m |= {"status": "BLOCKED", "reason": facts["hard_blocks"]}
                return m
            before = self.store.pointer(table)
            pre = Fingerprint(*map(int, before["fingerprint"]))
            current = self.store.read(table, before["version"])
            version = self.store.write_version(table, stage(current, self._read_head(b, table), d, b["base"][table]["key"]))
            one = self.spark.createDataFrame([(pre.n,)], "n long").selectExpr("n", f"cast('{pre.s1}' as decimal(38,0)) as s1", f"cast('{pre.s2}' as decimal(38,0)) as s2")
            e = expected_fingerprint(one, d).first()
            expected, staged = Fingerprint(int(e["n"]), int(e["s1"]), int(e["s2"])), fingerprint(self.store.read(table, version))
            if expected != staged:
                m |= {"status": "BLOCKED", "reason": "STAGING_FINGERPRINT_MISMATCH"}
                return m
            self.store.publish(table, version, mark=staged)
        self._sequence += 1
        m |= {"status": "MERGED", "pre_version": before["version"], "post_version": version, "pre": str(pre), "post": str(staged), "resolved_at": self._sequence, "applied": d.where("approved").count(), "refused": d.where("not approved").count()}
        b["status"] = "MERGED"
        self.store.log("merges", {k: v for k, v in m.items() if k != "facts"})
        return m

    def reject(self, merge_id: int, code: str) -> float:
        """Refuse a pending change-set; some reasons tighten the policy for what follows."""
        m = self.merges[merge_id - 1]
        if m["status"] not in ("PENDING", "BLOCKED"):
            raise StoreError("MERGE_NOT_PENDING", m["status"])
        m |= {"status": "REJECTED", "reason": code}
        self.min_confidence = gate.tightened(self.min_confidence, code)
        self._save()
        return self.min_confidence

    def unmerge(self, merge_id: int) -> dict:
        """Undo the newest applied change-set of a table exactly."""
        m = self.merges[merge_id - 1]
        if m["status"] != "MERGED" or m["unmerged_at"] is not None:
            raise StoreError("MERGE_NOT_PENDING", m["status"])
        later = [x for x in self.merges if x["table"] == m["table"] and x["status"] == "MERGED" and x["unmerged_at"] is None and x["resolved_at"] > m["resolved_at"]]
        if later:
            raise StoreError("UNMERGE_SUPERSEDED", ",".join(str(x["merge_id"]) for x in later))
        with self.store.lock():
            if str(fingerprint(self.store.read(m["table"]))) != m["post"]:
                raise StoreError("GOLDEN_CHANGED_SINCE_MERGE", m["table"])
            if str(fingerprint(self.store.read(m["table"], m["pre_version"]))) != m["pre"]:
                raise StoreError("STAGING_FINGERPRINT_MISMATCH", m["table"])
            self.store.rollback(m["table"], m["pre_version"])
        m["unmerged_at"] = self.clock()
        self._save()
        return m
