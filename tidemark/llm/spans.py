"""Long exact spans shared between records, by recompression.

Texts are parsed in rounds.  A round first names every run of one symbol, then every pair of a left and a right symbol,
where a hash of the symbol itself says which side it is on.  Names are hashes of what they stand for, so they are global
without any exchange: equal substrings get equal symbols except near their ends, in every record and on every machine.
Symbols stop growing at SYMBOL_SHARE of the least span (also a property of the symbol alone), so an equal stretch of
``least`` characters keeps a row of common interior symbols.  Runs that are longer become one symbol of their own.

Rows of GRAM symbols, thinned to the least of every WINDOW neighbours, are the high-level symbols that reveal repeats.
Spark counts them over all records; those in two or more records lead to pairs, whose texts are then compared along the
diagonal that the symbols give, character by character, so every reported span is exact and maximal.  A symbol row that
stands in more than HOT places isn't paired: there every window of ``least`` characters around it is named, and only
records with an equal window meet.  Copies of a whole text are taken together first and stand for each other.

Edge cases: null, empty and short texts share nothing; offsets count characters (code points); a record that repeats
itself only isn't reported; rows repeated with the same doc_id and text are one record; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.session import scratch

#: A symbol holds at most this share of the least span.
SYMBOL_SHARE = 0.08
ROUNDS, GRAM, WINDOW, HOT, CHUNK = 16, 5, 4, 256, 1_000_000
#: Copies are left out by a broadcast list up to this many ids (8 bytes each), by a shuffle beyond it.
MAX_BROADCAST_IDS = 500_000
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def recompress(texts: list[np.ndarray], max_symbol: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, length, text number, start) of the parse of several texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    symbol = _mix(np.concatenate(texts).astype(np.uint64) + _C)
    length = np.ones(len(symbol), dtype=np.int32)

    def runs(final: bool) -> None:
        nonlocal symbol, length, owner
        same = (symbol[1:] == symbol[:-1]) & (owner[1:] == owner[:-1])
        if not same.any():
            return
        at = np.flatnonzero(np.r_[True, ~same])
        count = np.diff(np.r_[at, len(symbol)]).astype(np.int32)
        total, name, owner = count * length[at], symbol[at], owner[at]
        many = count > 1
        small, large = many & (total <= max_symbol), many & (total > max_symbol)
        each = length[at]
        name = np.where(small, _mix(name * np.uint64(3) + count.astype(np.uint64) * _A), name)
        if final:  # a long run has one name, however long it is
            symbol, length = np.where(large, _mix(name ^ _C), name), total
            return
        again = np.where(large, count, 1)
        symbol, length, owner = np.repeat(name, again), np.repeat(np.where(large, each, total), again), np.repeat(owner, again)

    for turn in range(rounds):
        runs(False)
        side = (_mix(symbol + np.uint64(turn * 7919 + 13)) >> np.uint64(40)) & np.uint64(1)
        pair = np.flatnonzero((side[:-1] < side[1:]) & (owner[1:] == owner[:-1]) & (length[1:] + length[:-1] <= max_symbol))
        symbol, length = symbol.copy(), length.copy()
        symbol[pair] = _mix(_mix(symbol[pair] * _B + np.uint64(turn + 1)) ^ (symbol[pair + 1] * _A))
        length[pair] += length[pair + 1]
        keep = np.ones(len(symbol), dtype=bool)
        keep[pair + 1] = False
        symbol, length, owner = symbol[keep], length[keep], owner[keep]
    runs(True)
    start = np.cumsum(length, dtype=np.int64) - length - np.r_[0, np.cumsum(sizes)][:-1][owner]
    return symbol, length, owner, start


def symbol_rows(texts: list[np.ndarray], least: int, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, text number, start, end) of the thinned rows of ``gram`` symbols, and of runs of ``least`` and more."""
    symbol, length, owner, start = recompress(texts, max(2, int(least * SYMBOL_SHARE)))
    runs = np.flatnonzero(length >= least)
    extra = (_mix(symbol[runs] ^ _A), owner[runs], start[runs], start[runs] + length[runs])
    n = len(symbol) - gram + 1
    if n <= 0:
        return extra
    name = np.zeros(n, dtype=np.uint64)
    for i in range(gram):
        name = _mix(name * _B + symbol[i : n + i])
    whole = owner[:n] == owner[gram - 1 :]
    order = np.where(whole, name, np.uint64(0xFFFFFFFFFFFFFFFF))
    least_of = order.copy()
    for i in range(1, window):  # the least of each `window` neighbours, counted from either side
        least_of[: n - i] = np.minimum(least_of[: n - i], order[i:])
    chosen = np.zeros(n, dtype=bool)
    for i in range(window):
        chosen[i:] |= order[i:] == least_of[: n - i]
    at = np.flatnonzero(chosen & whole)
    last = at + gram - 1
    rows = (name[at], owner[at], start[at], start[last] + length[last])
    return tuple(np.concatenate([a, b]) for a, b in zip(rows, extra))


def _chunks(df: pd.DataFrame, column: str) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Whole texts in groups of some CHUNK characters, so that memory doesn't follow the batch."""
    ids, texts, size = [], [], 0
    for i, t in zip(df["doc_id"], df[column]):
        ids.append(i)
        texts.append(code_points(t))
        size += len(t)
        if size >= CHUNK:
            yield np.array(ids), texts
            ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids), texts


def _seeds(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for ids, texts in _chunks(df, "text"):
                name, owner, start, end = symbol_rows(texts, least)
                yield pd.DataFrame({"seed": name.view(np.int64), "doc_id": ids[owner], "p0": start.astype(np.int32), "p1": end.astype(np.int32)})

    return run


def _compare(least: int):
    """Maximal common runs along the given diagonals of two cut-outs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for d1, d2, lo1, lo2, t1, t2, diagonals in zip(df["d1"], df["d2"], df["lo1"], df["lo2"], df["t1"], df["t2"], df["diagonals"]):
                a, b = code_points(t1), code_points(t2)
                for g in diagonals:
                    shift = int(g) - lo1 + lo2  # place in a minus place in b
                    x, y = max(0, shift), max(0, -shift)
                    n = min(len(a) - x, len(b) - y)
                    if n < least:
                        continue
                    breaks = np.flatnonzero(a[x : x + n] != b[y : y + n])
                    edges = np.r_[-1, breaks, n]
                    for k in np.flatnonzero(np.diff(edges) > least):
                        s, e = int(edges[k]) + 1, int(edges[k + 1])
                        out.append((d1, d2, lo1 + x + s, lo2 + y + s, e - s))
            yield pd.DataFrame(out, columns=["d1", "d2", "a1", "a2", "n"])

    return run


def _windows(least: int):
    """The name of every window of ``least`` characters in a cut-out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for d, lo, t in zip(df["doc_id"], df["lo"], df["t"]):
                a = _mix(code_points(t).astype(np.uint64) + _C)
                if len(a) < least:
                    continue
                # two independent rolling names by repeated doubling
                names = []
                for base in (np.uint64(0x100000001B3), _C | np.uint64(1)):
                    h, width, power = a, 1, base
                    with np.errstate(over="ignore"):
                        for bit in bin(least)[3:]:
                            h, power, width = h[:-width] * power + h[width:], power * power, width * 2
                            if bit == "1":
                                h, power, width = h[:-1] * base + a[width : width + len(h) - 1], power * base, width + 1
                    names.append(_mix(h).view(np.int64))
                yield pd.DataFrame({"h1": names[0], "h2": names[1], "doc_id": d, "a": (lo + np.arange(len(names[0]))).astype(np.int32)}).drop_duplicates(["h1", "h2"])

    return run


def shared_spans(docs: DataFrame, least: int = 400, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(spans, copies) of docs(doc_id, text).

    spans(d1, d2, a1, a2, n): records d1 < d2 have n characters in common from a1 and a2 on, n at least ``least``;
    records stand for all copies of their text.  copies(rep, doc_id): the members of every set of equal texts.
    """
    spark = docs.sparkSession
    area = scratch(spark)
    long = docs.select("doc_id", "text").where(F.length("text") >= least)
    keys = long.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), F.length("text").alias("n"))
    sets = keys.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).where("rep <> other")
    copies = area.table(keys.join(sets.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).select("rep", "doc_id").distinct(), "copies")
    others = copies.where("rep <> doc_id").select("doc_id")
    others = F.broadcast(others) if others.count() <= MAX_BROADCAST_IDS else others
    single = long.join(others, "doc_id", "left_anti")

    seeds = area.table(single.mapInPandas(_seeds(least), "seed long, doc_id long, p0 int, p1 int"), "seeds")
    common = seeds.groupBy("seed").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count(F.lit(1)).alias("places")).where("x <> y").select("seed", "places")
    met = area.table(seeds.join(common, "seed"), "met")
    area.drop(seeds)

    # pairs of the usual symbols
    left = met.where(F.col("places") <= hot).select("seed", F.col("doc_id").alias("d1"), F.col("p0").alias("s1"), F.col("p1").alias("e1"))
    right = left.select("seed", F.col("d1").alias("d2"), F.col("s1").alias("s2"), F.col("e1").alias("e2"))
    ends = F.array(F.col("s1") - F.col("s2"), F.col("e1") - F.col("e2"))
    pairs = left.join(right, "seed").where("d1 < d2").select("d1", "d2", "s1", "s2", "e1", "e2", F.explode(F.array_distinct(ends)).alias("g"))
    pairs = pairs.groupBy("d1", "d2").agg(
        F.collect_set("g").alias("diagonals"),
        *[F.greatest(F.min(f"s{i}") - least, F.lit(0)).alias(f"lo{i}") for i in (1, 2)], *[(F.max(f"e{i}") + least).alias(f"hi{i}") for i in (1, 2)],
    )
    pairs = area.table(pairs, "pairs")
    involved = pairs.select(F.explode(F.array("d1", "d2")).alias("doc_id")).unionByName(met.where(F.col("places") > hot).select("doc_id")).distinct()
    texts = area.table(single.join(involved, "doc_id", "left_semi"), "texts")
    cut = lambda i: F.substring(f"text{i}", F.col(f"lo{i}") + 1, F.col(f"hi{i}") - F.col(f"lo{i}")).alias(f"t{i}")
    one = texts.select(F.col("doc_id").alias("d1"), F.col("text").alias("text1"))
    two = texts.select(F.col("doc_id").alias("d2"), F.col("text").alias("text2"))
    cuts = pairs.join(one, "d1").select("d1", "d2", "diagonals", "lo1", "lo2", "hi2", cut(1))
    cuts = cuts.join(two, "d2").select("d1", "d2", "diagonals", "lo1", "lo2", "t1", cut(2))
    shape = "d1 long, d2 long, a1 int, a2 int, n int"
    spans = cuts.mapInPandas(_compare(least), shape)

    # windows around the symbols that stand in very many places
    if met.where(F.col("places") > hot).limit(1).count():
        around = met.where(F.col("places") > hot).select("doc_id", (F.col("p0") - least).alias("lo"), (F.col("p1") + least).alias("hi"))
        around = around.groupBy("doc_id", F.floor(F.col("lo") / least).alias("part")).agg(F.greatest(F.min("lo"), F.lit(0)).alias("lo"), F.max("hi").alias("hi"))
        slices = around.join(texts, "doc_id").select("doc_id", "lo", F.substring("text", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("t"))
        named = area.table(slices.mapInPandas(_windows(least), "h1 long, h2 long, doc_id long, a int"), "windows")
        equal = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("h1", "h2")
        some = area.table(named.join(equal, ["h1", "h2"]), "equal")
        mate = some.select("h1", "h2", F.col("doc_id").alias("d2"), F.col("a").alias("a2"))
        found = some.select("h1", "h2", F.col("doc_id").alias("d1"), F.col("a").alias("a1")).join(mate, ["h1", "h2"]).where("d1 < d2")
        spans = spans.unionByName(found.select("d1", "d2", "a1", "a2", F.lit(least).alias("n")))
    return area.table(spans.distinct(), "spans"), copies


def expand_pairs(spans: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id_1, doc_id_2) of all records that share a span, copies of texts included."""
    linked = spans.select("d1", "d2").distinct()
    group = copies.select(F.col("rep").alias("d1"), F.col("doc_id").alias("m1"))
    other = copies.select(F.col("rep").alias("d2"), F.col("doc_id").alias("m2"))
    across = linked.join(group, "d1", "left").join(other, "d2", "left").select(F.coalesce("m1", "d1").alias("x"), F.coalesce("m2", "d2").alias("y"))
    within = group.join(other.withColumnRenamed("d2", "d1"), "d1").where("m1 < m2").select(F.col("m1").alias("x"), F.col("m2").alias("y"))
    return across.unionByName(within).select(F.least("x", "y").alias("doc_id_1"), F.greatest("x", "y").alias("doc_id_2")).distinct()


def shared_amount(docs: DataFrame, spans: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_chars, n_shared, links): how much of each record stands elsewhere too, in characters.

    ``class_id`` is the least id with an equal text, ``links`` the number of other classes that share a span.
    """
    from pyspark.sql import Window as W

    sides = spans.select("d1", "a1", "n").toDF("d", "a", "n").unionByName(spans.select("d2", "a2", "n").toDF("d", "a", "n"))
    ranges = sides.groupBy("d", "a").agg(F.max(F.col("a") + F.col("n")).alias("e"))
    before = F.max("e").over(W.partitionBy("d").orderBy("a").rowsBetween(W.unboundedPreceding, -1))
    own = F.greatest(F.col("e") - F.greatest(F.col("a"), F.coalesce(before, F.lit(0))), F.lit(0))
    covered = ranges.select("d", own.alias("own")).groupBy("d").agg(F.sum("own").alias("covered"))
    links = spans.select("d1", "d2").distinct().select(F.explode(F.array("d1", "d2")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("links"))
    base = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    out = base.join(copies, "doc_id", "left").withColumn("d", F.coalesce("rep", "doc_id")).join(covered, "d", "left").join(links, "d", "left")
    shared = F.when(F.col("rep").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return out.select("doc_id", F.col("d").alias("class_id"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce(shared, F.lit(0)).cast("long").alias("n_shared"), F.coalesce("links", F.lit(0)).alias("links"))
