"""May a change-set be applied by itself?  Risk, the decision ladder and a policy that only tightens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Tier:
    tier: int
    max_changed: int
    max_risk: float
    allow_deletes: bool
    max_delete_pct: float


#: What each tier of autonomy allows.
TIERS = {0: Tier(0, 0, 0.0, False, 0.0), 1: Tier(1, 0, 0.0, False, 0.0), 2: Tier(2, 30000, 200.0, True, 1.0), 3: Tier(3, 60000, 2000.0, True, 5.0)}
#: Ceiling of deletes at any tier, weights of kinds of change, step and cap of the tightening, its codes.
HARD_DELETE_PCT = 5.0
WEIGHTS = {"deleted": 1.0, "changed": 0.7, "added": 0.2}
STEP, CAP = 0.05, 0.98
TIGHTENING = ("WRONG_MATCH", "DATA_LOSS", "POLICY_VIOLATION")


def kind_weight() -> Column:
    """Weight of the gravest kind of change, over columns added, changed and deleted."""
    return F.when(F.col("deleted") > 0, WEIGHTS["deleted"]).when(F.col("changed") > 0, WEIGHTS["changed"]).when(F.col("added") > 0, WEIGHTS["added"]).otherwise(0.0)


def decide(facts: DataFrame, tier: Tier, gate_enabled: bool = True, min_confidence: float = 0.0, hard_delete_pct: float = HARD_DELETE_PCT) -> DataFrame:
    """facts(added, changed, deleted, table_rows, needs_review, hard_blocks, confidence) -> with total, delete_pct, risk,
    decision and reason.

    ``hard_blocks`` is a comma list.  The first rung of the ladder that holds decides.
    """
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0))))
    out = facts.withColumn("total", F.col("added") + F.col("changed") + F.col("deleted"))
    out = out.withColumn("delete_pct", F.when(F.col("table_rows") > 0, 100.0 * F.col("deleted") / F.col("table_rows")).otherwise(0.0))
    out = out.withColumn("risk", F.col("total") * (F.lit(1.0) - conf) * kind_weight())
    over = F.col("delete_pct") > hard_delete_pct
    blocks = F.concat_ws(",", F.nullif(F.col("hard_blocks"), F.lit("")), F.when(over, "DELETE_PCT_EXCEEDED"))
    rungs = [
        (blocks != "", "BLOCKED", blocks),
        (F.lit(not gate_enabled), "MERGE", F.lit("GATE_DISABLED")),
        (F.lit(tier.max_changed <= 0), "PENDING", F.lit(f"TIER_{tier.tier}_CANNOT_MERGE")),
        (F.col("total") > tier.max_changed, "PENDING", F.lit("TOO_MANY_ROWS")),
        ((F.col("deleted") > 0) & F.lit(not tier.allow_deletes), "PENDING", F.lit("DELETES_NOT_ALLOWED_AT_TIER")),
        (F.col("delete_pct") > tier.max_delete_pct, "PENDING", F.lit("DELETE_PCT")),
        (F.coalesce("confidence", F.lit(0.0)) < min_confidence, "PENDING", F.lit("BELOW_MIN_CONFIDENCE")),
        (F.col("risk") > tier.max_risk, "PENDING", F.lit("RISK")),
        (F.col("needs_review") > 0, "PENDING", F.lit("ROWS_NEED_REVIEW")),
        (F.lit(True), "MERGE", F.lit("WITHIN_TIER")),
    ]
    pick = None
    for test, decision, reason in rungs:
        s = F.struct(F.lit(decision).alias("decision"), reason.alias("reason"))
        pick = F.when(test, s) if pick is None else pick.when(test, s)
    return out.withColumn("d", pick).select("*", "d.decision", "d.reason").drop("d")


def allowed_rows(tier: Tier) -> Column:
    """How many rows a change-set of this confidence and kind may hold, over columns confidence and the counts."""
    spread = (F.lit(1.0) - F.coalesce("confidence", F.lit(0.0))) * kind_weight()
    return F.least(F.lit(float(tier.max_changed)), F.when(spread > 0, F.lit(tier.max_risk) / spread).otherwise(F.lit(float(tier.max_changed))))


def tightened(current: float, reject_code: str | None) -> float:
    """The minimum confidence after a rejection; it never falls."""
    return max(current, min(CAP, current + STEP)) if reject_code in TIGHTENING else current
