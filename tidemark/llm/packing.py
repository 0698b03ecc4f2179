"""Filling fixed-capacity containers with texts, counted in tokens of a public tokenizer.

Hierarchical packing over tiers of lengths.  Each text is routed to a tier: those longer than half the capacity, than a
quarter, than an eighth, and the rest.  Each tier is packed by itself, from the longest on: a container is opened by the
tier's longest text left and filled with texts of its own tier; the gap that stays is then filled from the shorter
tiers, the next shorter one first, longest fit first, with a two-item look-ahead that prefers an exact fill.  What the
gaps took no longer stands in the shorter tiers when their turn comes.

Texts of equal length are interchangeable, so packing needs only the histogram of lengths: at most ``capacity`` numbers,
whatever the number of documents, which the driver packs.  A pattern of lengths is repeated as long as the histogram
allows, which at least halves what is left of one of its lengths, so the plan has at most log2(documents) patterns for
each length.

Documents find their place by rank: a document is numbered within its length by salted, pre-aggregated counts, and the
plan maps ranges of these numbers to containers.  A length, source or group may hold any share of the documents.

Texts longer than the capacity, and only these, are cut: their full pieces fill containers of their own, the rest is
packed as an item.  Containers are dealt to step groups of ``group`` containers in serpentine order of their fill, so
that all groups carry nearly the same number of tokens.

Edge cases: null and empty texts have no tokens; they get place in container 0 with zero tokens.  Rows repeated with the
same doc_id and text are one document.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.session import scratch

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TIERS, LOOK = 4, 64
#: Rows of one length that a task numbers; more are salted.
NUMBERED = 200_000


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every document; the vocabulary file is shipped to the tasks."""
    with open(os.path.join(folder or TOKENIZERS, vocabulary), "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped.value.splitlines())}
        encode = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for df in batches:
            yield pd.DataFrame({"doc_id": df["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in df[text]]})

    return docs.select("doc_id", text).mapInPandas(run, "doc_id long, n_tokens long")


class Pattern:
    """Items that share a container: runs of (length, how many), and how many containers look like this."""

    __slots__ = ("runs", "times", "fill", "tier")

    def __init__(self, runs: list[tuple[int, int]], times: int, tier: int = 0):
        self.runs, self.times, self.fill, self.tier = runs, times, sum(s * k for s, k in runs), tier


def tier_of(size: int, capacity: int) -> int:
    """0 for texts longer than half the capacity, 1 than a quarter and so on; the last tier has all shorter ones."""
    return min(TIERS - 1, (capacity // size).bit_length() - 1)


class Tier:
    """Lengths of a tier, ascending, of which texts are left."""

    def __init__(self, counts: dict[int, int]):
        self.left, self.lengths = dict(counts), sorted(counts)

    def fit(self, gap: int, taken: dict[int, int]) -> int:
        """The longest length within the gap of which a text is left, or, among the LOOK next shorter ones, one that fills
        the gap exactly, by itself or with a partner; 0 if none fits."""
        free = lambda s: self.left.get(s, 0) - taken.get(s, 0)
        longest, at = 0, bisect.bisect_right(self.lengths, gap) - 1
        for i in range(at, -1, -1):
            if longest and i < at - LOOK:
                break
            if free(s := self.lengths[i]) > 0:
                longest = longest or s
                rest = gap - s
                if rest == 0 or free(rest) - (rest == s) > 0:
                    return s
        return longest

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.lengths.pop(bisect.bisect_left(self.lengths, size))


def pack_tiers(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every text of a histogram length -> count (lengths 1..capacity), fullest first."""
    routed: list[dict[int, int]] = [{} for _ in range(TIERS)]
    for size, n in counts.items():
        routed[tier_of(size, capacity)][size] = n
    tiers, out = [Tier(x) for x in routed], []
    for t, own in enumerate(tiers):
        while own.lengths:
            head = own.lengths[-1]
            taken, gap = {head: 1}, capacity - head
            for tier in tiers[t:]:  # its own tier first, then gaps from shorter ones
                while gap > 0 and (s := tier.fit(gap, taken)):
                    taken[s] = taken.get(s, 0) + 1
                    gap -= s
            home = {s: tiers[tier_of(s, capacity)] for s in taken}
            times = min(home[s].left[s] // k for s, k in taken.items())
            for s, k in taken.items():
                home[s].take(s, k * times)
            out.append(Pattern(sorted(taken.items(), reverse=True), times, t))
    return sorted(out, key=lambda p: (-p.fill, p.runs))


def _plan(patterns: list[Pattern]) -> pd.DataFrame:
    """Rank ranges of each length -> first container, items a container, first slot and offset."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for p in patterns:
        slot = offset = 0
        for s, k in p.runs:
            first = used.get(s, 0)
            used[s] = first + k * p.times
            rows.append((s, first, base, k, slot, offset, p.tier))
            slot, offset = slot + k, offset + s * k
        base += p.times
    return pd.DataFrame(rows, columns=["size", "first", "base", "k", "slot", "offset", "tier"]).sort_values(["size", "first"], ignore_index=True)


def _numbered(df: DataFrame, by: list[str], amount, name: str, salts: int) -> DataFrame:
    """Running sum of ``amount`` before each row, by ``by``, without bringing a group into one task."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).withColumn("amount", amount)
    inner = W.partitionBy(*by, "salt").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    sums = salted.groupBy(*by, "salt").agg(F.sum("amount").alias("total"))  # combined map-side: at most lengths x salts rows
    outer = W.partitionBy(*by).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*by, "salt", F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("start"))
    own = F.coalesce(F.sum("amount").over(inner), F.lit(0))
    return salted.withColumn("own", own).join(starts, [*by, "salt"]).withColumn(name, F.col("own") + F.col("start")).drop("salt", "amount", "own", "start")


def pack(docs: DataFrame, capacities: dict[int, int], group: int = 64, text: str = "text") -> DataFrame:
    """(pack_id, doc_id, piece, container_id, slot, start_token, n_tokens, step_group, tier) for each document and capacity.

    ``capacities`` maps pack_id to tokens.  ``piece`` counts the parts of a text that had to be cut, from 0;
    ``start_token`` is the place of the piece's first token in its container, ``tier`` the container's tier.
    """
    spark: SparkSession = docs.sparkSession
    area = scratch(spark)
    sizes = area.table(token_counts(docs, text).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), "sizes")
    caps = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in sorted(capacities.items())])).alias("c")
    each = sizes.select("doc_id", "n_tokens", caps).select("doc_id", "n_tokens", "c.*")
    each = each.withColumn("full", F.floor(F.col("n_tokens") / F.col("capacity"))).withColumn("size", F.col("n_tokens") % F.col("capacity"))
    histogram: dict[int, dict[int, int]] = {p: {} for p in capacities}
    totals: dict[int, int] = {}
    for r in each.groupBy("pack_id", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect():  # at most `capacity` rows each
        if r["size"]:
            histogram[r["pack_id"]][r["size"]] = r["n"]
        totals[r["pack_id"]] = totals.get(r["pack_id"], 0) + r["full"]
    patterns = {p: pack_tiers(h, capacities[p]) for p, h in histogram.items()}
    salts = max(8, -(-max((n for h in histogram.values() for n in h.values()), default=0) // NUMBERED), -(-max(totals.values(), default=0) // NUMBERED))
    planned = {p: sum(x.times for x in own) for p, own in patterns.items()}
    plans = {p: _plan(own) for p, own in patterns.items()}
    groups = {p: max(1, -(-(planned[p] + totals.get(p, 0)) // group)) for p in capacities}
    shipped = spark.sparkContext.broadcast((plans, planned, groups))

    def step(container: np.ndarray, full: bool, p: int) -> np.ndarray:
        """Serpentine deal: cut texts' full containers are the fullest, then the planned ones by falling fill."""
        _, planned, groups = shipped.value
        at = container - planned[p] if full else container + 0
        turn, place = np.divmod(at, groups[p])
        return np.where(turn % 2 == 0, place, groups[p] - 1 - place)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans = shipped.value[0]
        for df in batches:
            for p, own in df.groupby("pack_id"):
                plan, n = plans[p], len(own)
                size, rank = own["size"].to_numpy(), own["rank"].to_numpy()
                out = pd.DataFrame({"pack_id": own["pack_id"].astype("int32"), "doc_id": own["doc_id"], "piece": own["full"], "container_id": np.zeros(n, "int64"), "slot": rank, "start_token": np.zeros(n, "int64"), "n_tokens": size, "step_group": np.zeros(n, "int64"), "tier": np.full(n, TIERS - 1, "int32")})
                if (some := size > 0).any():
                    span = np.int64(1) << 40
                    keys = plan["size"].to_numpy() * span + plan["first"].to_numpy()
                    at = np.searchsorted(keys, size[some] * span + rank[some], side="right") - 1
                    take = lambda c: plan[c].to_numpy()[at]
                    turn, nth = np.divmod(rank[some] - take("first"), take("k"))
                    container = take("base") + turn
                    out.loc[some, "container_id"] = container
                    out.loc[some, "slot"] = take("slot") + nth
                    out.loc[some, "start_token"] = take("offset") + nth * size[some]
                    out.loc[some, "step_group"] = step(container, False, p)
                    out.loc[some, "tier"] = take("tier").astype("int32")
                yield out

    schema = "pack_id int, doc_id long, piece long, container_id long, slot long, start_token long, n_tokens long, step_group long, tier int"
    items = _numbered(each.where("size > 0 or n_tokens = 0"), ["pack_id", "size"], F.lit(1), "rank", salts)
    placed = items.select("pack_id", "doc_id", "full", "size", "rank").mapInPandas(place, schema)
    cut = _numbered(each.where("full > 0"), ["pack_id"], F.col("full"), "before", salts).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for p, own in df.groupby("pack_id"):
                container = shipped.value[1][p] + own["before"].to_numpy() + own["piece"].to_numpy()
                yield pd.DataFrame({"pack_id": own["pack_id"].astype("int32"), "doc_id": own["doc_id"], "piece": own["piece"], "container_id": container, "slot": 0, "start_token": 0, "n_tokens": own["capacity"], "step_group": step(container, True, p), "tier": np.int32(0)})

    return placed.unionByName(cut.select("pack_id", "doc_id", "before", "piece", "capacity").mapInPandas(whole, schema))
