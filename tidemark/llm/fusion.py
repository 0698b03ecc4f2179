"""Best representative of each duplicate group by Bayesian fusion with copy detection.

Members' field values are claims of their source.  From all claims the accuracy of each source on a field is estimated,
and for each two sources the chance that one copies the other: agreeing on values that the posterior holds false is
evidence of copying, agreeing on true ones hardly is, differing speaks against it.  A vote weighs
log(N * accuracy / (1 - accuracy)); votes of sources that likely copy one another are discounted.  Accuracies,
dependence and posteriors are estimated in turn for some rounds.  There may be any number of sources.

The surviving value is the one of largest posterior: the log-odds of its votes plus the prior log-odds of the member that
states it.  A declared policy is such a prior: with ``policy="declared"`` a member that the group's survivorship text
names has NAMED more than others, one with a valid time DATED more than others, and a microsecond later is worth LATER,
which is more than votes can be; of members that are equal in all this the one with the smaller id speaks for them.
With ``policy="votes"`` the priors are equal and the votes decide.

The statistics are a few numbers for each field and two sources; nothing else reaches the driver.  Members of a group are
only ever reduced by aggregates that combine map-side, so a group may hold any share of the rows.

Edge cases: unusable values (null, blank, stand-ins, impossible dates) make no claim; a group without a usable value has
no row for the field; a member whose record does not exist makes no claim; repeated records and references count once;
times that are null or after the extraction day are earlier than all others; ties go to the smaller record id.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.clean import date_of, usable
from tidemark.session import scratch

FIELDS = ("FULL_NAME", "EMAIL", "PHONE", "ADDRESS", "DATE_OF_BIRTH")
#: False values that a source may state for a field, as usual in truth discovery.
FALSE_VALUES = 50
#: Chance beforehand that a source copies another, and share of its values that a copier copies.
COPIES, COPIED = 0.1, 0.8
#: Prior log-odds of a declared policy; those of votes stay below LATER for up to some 20 sources of any accuracy.
NAMED, DATED, LATER = 10**24, 10**22, 200


def members(golden: DataFrame) -> DataFrame:
    """(golden_id, record_id) of golden rows with two or more different members; one row a member."""
    refs = F.concat(F.array("source_a_ref", "source_b_ref"), F.split(F.coalesce("merged_a_refs", F.lit("")), ","))
    refs = F.array_distinct(F.filter(F.transform(refs, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    many = golden.select("golden_id", "survivorship", refs.alias("refs")).where(F.size("refs") > 1)
    return many.select("golden_id", "survivorship", F.explode("refs").alias("record_id")).dropDuplicates(["golden_id", "record_id"])


def _records(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sources in one shape, repeated rows once; each value null unless it is usable."""
    def own(value: Column) -> Column:
        return F.when(usable(value), value)

    def born(value: Column) -> Column:
        return F.when(F.year(date_of(value)) > 1910, F.date_format(date_of(value), "yyyy-MM-dd"))

    name = F.concat_ws(" ", F.expr("nullif(first_name, '')"), F.expr("nullif(last_name, '')"))
    left = a.select(F.col("cust_id").alias("record_id"), F.lit("A").alias("src"), F.col("created_at").alias("at"), F.struct(
        F.coalesce("full_name", F.lit("")).alias("FULL_NAME"), own(F.col("email")).alias("EMAIL"), own(F.col("phone")).alias("PHONE"),
        own(F.col("addr_line")).alias("ADDRESS"), born(F.col("date_of_birth")).alias("DATE_OF_BIRTH")).alias("f"))
    right = b.select(F.col("client_ref").alias("record_id"), F.lit("B").alias("src"), F.col("last_seen").alias("at"), F.struct(
        name.alias("FULL_NAME"), own(F.col("email_addr")).alias("EMAIL"), own(F.col("mobile")).alias("PHONE"),
        own(F.col("street")).alias("ADDRESS"), born(F.col("dob")).alias("DATE_OF_BIRTH")).alias("f"))
    return left.unionByName(right).groupBy("record_id").agg(F.first("src").alias("src"), F.max("at").alias("at"), F.max("f").alias("f"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _declared(texts: pd.Series) -> pd.Series:
    """The source, A or B, named for each field; nothing for any other word or text that isn't whole JSON."""

    def one(text):
        try:
            named = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None
        if not isinstance(named, dict):
            return None
        words = [named.get(f) for f in FIELDS]
        return [w.upper() if isinstance(w, str) and w.upper() in ("A", "B") else None for w in words]

    return texts.map(one)


def claims(golden: DataFrame, a: DataFrame, b: DataFrame, extracted: str) -> DataFrame:
    """(golden_id, field_name, record_id, src, value, named, at): every usable value of every member."""
    with_policy = members(golden).join(_records(a, b), "record_id")
    text = F.col("survivorship").isNotNull() & (F.trim("survivorship") != "")
    with_policy = with_policy.withColumn("declared", F.when(text, _declared("survivorship")))
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"f.{f}").alias("value"), F.coalesce(F.col("declared")[i] == F.col("src"), F.lit(False)).alias("named")) for i, f in enumerate(FIELDS)])
    at = F.when(F.to_date("at") <= F.lit(extracted).cast("date"), F.col("at"))
    return with_policy.select("golden_id", "record_id", "src", at.alias("at"), F.explode(each).alias("c")).select("golden_id", "record_id", "src", "at", "c.*").where("value is not null")


def _match_key(value: Column) -> Column:
    """Values that differ only in letter case, blanks or punctuation support each other."""
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}@]+", ""))


def _vote_weights(stats: dict[tuple[str, str], float], copying: dict[tuple[str, str, str], float]):
    """(field, sources) -> log-odds that the votes of these sources give a value; the more accurate ones speak first."""
    known: dict[tuple, float] = {}

    def weigh(field: str, sources: list[str]) -> float:
        key = (field, *sorted(sources))
        if key not in known:
            order = sorted(key[1:], key=lambda s: (-stats.get((field, s), 0.8), s))
            total = 0.0
            for i, s in enumerate(order):
                own = 1.0
                for t in order[:i]:
                    own *= 1 - COPIED * copying.get((field, *sorted((s, t))), COPIES)
                acc = stats.get((field, s), 0.8)
                total += own * math.log(FALSE_VALUES * acc / (1 - acc))
            known[key] = total
        return known[key]

    return weigh


def _posteriors(votes: DataFrame, stats: dict, copying: dict) -> DataFrame:
    """votes(golden_id, field_name, k, srcs) -> with s, the log-odds of its votes, and p, the posterior of value k."""
    weigh = _vote_weights(stats, copying)

    @F.pandas_udf("double")
    def score(field: pd.Series, srcs: pd.Series) -> pd.Series:
        return pd.Series([weigh(f, list(x)) for f, x in zip(field, srcs)], dtype="float64")

    scored = votes.withColumn("s", score("field_name", "srcs"))
    # values that nobody states share what is left
    total = scored.groupBy("golden_id", "field_name").agg(F.sum(F.exp("s")).alias("z"), F.count(F.lit(1)).alias("n"))
    rest = F.greatest(F.lit(FALSE_VALUES) + 1 - F.col("n"), F.lit(0))
    return scored.join(total, ["golden_id", "field_name"]).withColumn("p", F.exp("s") / (F.col("z") + rest))


def dependence(acc1: float, acc2: float, true: float, false: float, differ: float) -> float:
    """The chance that one of two sources copies the other, from how many values they share, by their truth, and don't."""
    lone, both = (1 - acc1) * (1 - acc2) / FALSE_VALUES, acc1 * acc2
    acc = (acc1 + acc2) / 2
    odds = math.log(COPIES / (1 - COPIES)) + differ * math.log(1 - COPIED)
    odds += true * math.log((COPIED * acc + (1 - COPIED) * both) / both) + false * math.log((COPIED * (1 - acc) + (1 - COPIED) * lone) / lone)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def fused(said: DataFrame, rounds: int = 3) -> tuple[DataFrame, dict, dict]:
    """Posteriors of values from said(golden_id, field_name, src, k), with accuracies (field, source) and the chances of
    copying (field, source, source)."""
    area = scratch(said.sparkSession)
    votes = area.table(said.groupBy("golden_id", "field_name", "k").agg(F.array_sort(F.collect_set("src")).alias("srcs")), "votes")
    two = lambda c: F.flatten(F.transform(c, lambda x: F.transform(F.filter(c, lambda y: y > x), lambda y: F.struct(x.alias("s1"), y.alias("s2")))))
    # how often two sources speak of one thing; sets of sources, not of members
    items = said.groupBy("golden_id", "field_name").agg(F.array_sort(F.collect_set("src")).alias("srcs")).where(F.size("srcs") > 1)
    together = {(r["field_name"], r["s1"], r["s2"]): r["n"] for r in items.select("field_name", F.inline(two(F.col("srcs")))).groupBy("field_name", "s1", "s2").agg(F.count(F.lit(1)).alias("n")).collect()}
    stats: dict[tuple[str, str], float] = {}
    copying: dict[tuple[str, str, str], float] = {}
    for _ in range(rounds):
        p = _posteriors(votes, stats, copying).where("n > 1 or size(srcs) > 1").select("field_name", "srcs", "p")
        one = F.transform("srcs", lambda x: F.struct(x.alias("s1"), F.lit(None).cast("string").alias("s2")))
        sums = p.select("field_name", "p", F.inline(F.concat(one, two(F.col("srcs"))))).groupBy("field_name", "s1", "s2").agg(F.sum("p").alias("true"), F.count(F.lit(1)).alias("n")).collect()  # a row for each field and two sources
        for r in sums:
            if r["s2"] is not None:
                f, s, t = r["field_name"], r["s1"], r["s2"]
                differ = max(0, together.get((f, s, t), 0) - r["n"])
                copying[f, s, t] = dependence(stats.get((f, s), 0.8), stats.get((f, t), 0.8), r["true"], r["n"] - r["true"], differ)
        for r in sums:
            if r["s2"] is None:
                stats[r["field_name"], r["s1"]] = min(0.99, max(0.3, (r["true"] + 1.6) / (r["n"] + 2)))
    return _posteriors(votes, stats, copying).select("golden_id", "field_name", "k", "s", "p"), stats, copying


def survivors(said: DataFrame, best: DataFrame, policy: str = "declared") -> DataFrame:
    """The member of largest posterior for each group and field, of said(golden_id, field_name, record_id, k, value, named, at)."""
    tied = ["golden_id", "field_name", "named", "at"] if policy == "declared" else ["golden_id", "field_name", "k"]
    speaks = said.groupBy(*tied).agg(F.min_by(F.struct("record_id", "value", *([] if "k" in tied else ["k"])), "record_id").alias("m")).select(*tied, "m.*")
    rated = speaks.join(best, ["golden_id", "field_name", "k"])
    log_odds = F.round("s", 6).cast("decimal(38,6)")
    if policy == "declared":
        exact = lambda c: c.cast("decimal(38,6)")  # noqa: E731, beside these a vote would vanish in a double
        when = F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(0)).cast("decimal(20,0)")
        prior = exact(F.when(F.col("named"), F.lit(str(NAMED))).otherwise("0")) + exact(F.when(F.col("at").isNotNull(), F.lit(str(DATED))).otherwise("0")) + exact(when * F.lit(LATER).cast("decimal(6,0)"))
        log_odds = (prior + log_odds).cast("decimal(38,6)")
    top = F.struct((-log_odds).alias("odds"), F.col("record_id").alias("id"))
    return rated.groupBy("golden_id", "field_name").agg(F.min_by(F.struct("record_id", "value", F.round("p", 6).alias("posterior")), top).alias("w")).select("golden_id", "field_name", "w.*")


def fuse(golden: DataFrame, a: DataFrame, b: DataFrame, policy: str = "declared", extracted: str = "2026-06-30", rounds: int = 3) -> DataFrame:
    """(golden_id, field_name, record_id, value, posterior): the surviving value of each field and the record it is from."""
    area = scratch(golden.sparkSession)
    said = area.table(claims(golden, a, b, extracted).withColumn("k", _match_key(F.col("value"))), "claims")
    return survivors(said, fused(said, rounds)[0], policy)
