"""Mapping free-entered values to a canonical list by a symmetric-delete dictionary.

Every reference name is entered in a dictionary under itself and under all texts that one or two deletions make of it.
A value is looked up with its own deletions, so every name within the edit bound is met without scanning the list; the
candidates are ranked by a weighted Damerau-Levenshtein distance (neighbouring keys, doubled letters and exchanged
letters cost less) and, where equal, by how often the reference entry stands correctly in the data.  The frequencies are
counted over all rows and are as many as the reference has entries.

Exact names come first: the reference's names and codes and further names of its entries where the caller knows some (for
countries see ``countries``).  Values that lead nowhere are reported as UNMATCHED.

A reference of up to MAX_ENTRIES entries, whose dictionary has at most MAX_DICTIONARY texts, is shipped to the tasks, and
rows are mapped where they lie: no shuffle, so no value, however frequent, makes a hot task.  A larger reference is never
shipped: the deletions of its names and of the forms of the distinct values are joined, with the same further names, forms,
parts, bounds and ranking, so both ways give the same codes.

Edge cases: null and empty values are left out, blank ones and stand-ins are UNMATCHED; a row repeated in all columns is
reported once; a tie of distance and frequency goes to the smaller code.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.clean import STAND_INS
from tidemark.session import scratch

UNMATCHED = "UNMATCHED"
MAX_ENTRIES, MAX_DICTIONARY = 5_000, 2_000_000
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEAR = {(a, b) for r, row in enumerate(KEYS) for i, a in enumerate(row) for q, other in enumerate(KEYS) for j, b in enumerate(other) if a != b and abs(r - q) <= 1 and abs(i - j) <= 1}


def fold(text: str) -> str:
    """Lower case without accents, punctuation as blanks, dotted initials joined: ``U. S. A.`` is ``usa``."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    text = " ".join(re.sub(r"[\W_]+", " ", text).split())
    return re.sub(r"\b(\w) (?=\w\b)", r"\1", text)


def deletions(word: str, depth: int) -> set[str]:
    """The word and everything left of it after up to ``depth`` deletions."""
    return {"".join(word[i] for i in range(len(word)) if i not in gone) for d in range(depth + 1) for gone in map(set, combinations(range(len(word)), d)) if d < len(word)}


def typo_distance(typed: str, meant: str, bound: int) -> tuple[int, float] | None:
    """(edits, weighted cost) of Damerau-Levenshtein; None beyond ``bound`` edits."""
    n, m = len(typed), len(meant)
    if abs(n - m) > bound:
        return None
    far = (bound + 1, 9.0)
    rows = [[(j, 0.9 * j) for j in range(m + 1)]]
    for i in range(1, n + 1):
        row = [(i, 0.9 * i)] + [far] * m
        for j in range(1, m + 1):
            a, b = typed[i - 1], meant[j - 1]
            e, w = rows[i - 1][j - 1]
            best = (e, w) if a == b else (e + 1, w + (0.6 if (a, b) in _NEAR else 1.0))
            e, w = rows[i - 1][j]
            best = min(best, (e + 1, w + (0.5 if i > 1 and typed[i - 2] == a else 0.8)))
            e, w = row[j - 1]
            best = min(best, (e + 1, w + (0.7 if j > 1 and meant[j - 2] == b else 0.8)))
            if i > 1 and j > 1 and a == meant[j - 2] and typed[i - 2] == b and a != b:
                e, w = rows[i - 2][j - 2]
                best = min(best, (e + 1, w + 0.5))
            row[j] = best
        rows.append(row)
    return rows[n][m] if rows[n][m][0] <= bound else None


def forms_of(key: str, formal: frozenset[str], short: dict[str, str]) -> list[str]:
    """The text with its short words written out, and without the formal words."""
    words = key.split()
    bare = [w for w in words if w not in formal]
    return [" ".join(short.get(w, w) for w in words), " ".join(bare), " ".join(short.get(w, w) for w in bare)]


def stands_in(value: str) -> bool:
    plain = " ".join(value.split()).casefold()
    return not plain or plain in STAND_INS


def parts_of(value: str) -> list[str]:
    """The parts of "GB - United Kingdom", "Spain (ES)"."""
    return [p for p in re.split(r"\s+-\s+|[()/,;]", value) if p.strip()]


def bound_of(name: str, main: bool) -> int:
    """Edits allowed for a name: none for short aliases, two for names of the list."""
    if main:
        return 2 if len(name) >= 5 else 1
    return 1 if len(name) >= 7 and name.isascii() else 0


class Dictionary:
    """The symmetric-delete index of a reference list, as shipped to tasks."""

    def __init__(self, entries: dict[str, str], aliases: dict[str, set[str]], frequency: dict[str, int], codes: bool = True, formal: frozenset[str] = frozenset(), short: dict[str, str] | None = None):
        self.codes = {c.casefold(): c for c in sorted(entries, reverse=True)} if codes else {}
        self.formal, self.short = formal, short or {}
        self.frequency, self.names = frequency, {}
        claimed: dict[str, set[str]] = {}
        for code, names in aliases.items():
            for x in names:
                if key := fold(x):
                    claimed.setdefault(key, set()).add(code)
        self.names = {k: next(iter(v)) for k, v in claimed.items() if len(v) == 1}
        self.names |= {fold(name): code for code, name in sorted(entries.items(), reverse=True)}  # of one name the smaller code
        self.main = {fold(name) for name in entries.values()}
        self.index: dict[str, set[str]] = {}
        for name in self.names:
            if depth := self.bound(name):
                for x in deletions(name, depth):
                    self.index.setdefault(x, set()).add(name)
        self.longest = max(map(len, self.names), default=0)
        self.known: dict[str, str] = {}

    def bound(self, name: str) -> int:
        """Edits allowed for a name: none for short aliases, two for names of the list."""
        return bound_of(name, name in self.main)

    def exact(self, key: str) -> str | None:
        if code := self.codes.get(key) or self.names.get(key):
            return code
        return next((code for form in self.forms(key) if (code := self.names.get(form))), None)

    def forms(self, key: str) -> list[str]:
        """The text with its short words written out, and without the formal words."""
        return forms_of(key, self.formal, self.short)

    def near(self, key: str) -> str | None:
        best = None
        for name in {n for x in deletions(key, 2) for n in self.index.get(x, ())} if len(key) <= self.longest + 2 else ():  # longer ones are beyond every bound
            if d := typo_distance(key, name, self.bound(name)):
                rank = (d[0] + (name not in self.main) * 0.5, d[1], -self.frequency.get(self.names[name], 0), self.names[name])
                best = min(best, (rank, self.names[name])) if best else (rank, self.names[name])
        return best and best[1]

    def resolve(self, value: str) -> str:
        """The code meant by a typed value, or UNMATCHED."""
        if value not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[value] = self._resolve(value)
        return self.known[value]

    def _resolve(self, value: str) -> str:
        if stands_in(value):
            return UNMATCHED
        if code := self.exact(fold(value)):
            return code
        parts = parts_of(value)
        if len(parts) > 1:  # parts that agree
            found = {c for p in parts if (c := self.exact(fold(p)))}
            if len(found) == 1:
                return found.pop()
        key = fold(value)
        forms = dict.fromkeys([key, *self.forms(key)])
        return next((code for form in forms if form and (code := self.near(form))), UNMATCHED)


def map_values(values: DataFrame, dictionary: Dictionary) -> DataFrame:
    """values(record_id, value) -> (record_id, code), row by row in Arrow batches."""
    shared = values.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for df in batches:
            yield pd.DataFrame({"record_id": df["record_id"], "code": df["value"].map(own.resolve)})

    return values.mapInPandas(run, "record_id string, code string")


def _small(listed: list, texts: int = MAX_DICTIONARY) -> bool:
    """Whether a list of (code, name) makes a dictionary that may be shipped."""
    return len(listed) <= MAX_ENTRIES and sum(1 + len(x) + len(x) * (len(x) - 1) // 2 for _, x in listed) <= texts


def map_to_reference(values: DataFrame, reference: DataFrame, code: str, name: str, aliases: dict[str, set[str]] | None = None, formal: frozenset[str] = frozenset(), short: dict[str, str] | None = None, max_texts: int = MAX_DICTIONARY) -> DataFrame:
    """values(record_id, value) -> (record_id, code) with UNMATCHED for misses.

    ``aliases`` gives further names by code, ``formal`` words that don't tell entries apart, ``short`` words written short.
    """
    listed = reference.where(F.col(code).isNotNull() & F.col(name).isNotNull()).select(F.col(code).cast("string").alias("code"), F.col(name).alias("name"))
    listed = listed.distinct()  # of several names of a code the others are further names
    some = listed.limit(MAX_ENTRIES + 1).collect()
    if not _small(some, max_texts):
        return map_by_join(values, listed, aliases or {}, formal, short or {})
    entries = {r[0]: r[1] for r in sorted(some, reverse=True)}
    own: dict[str, set[str]] = {c: {*names} for c, names in (aliases or {}).items()}
    for c, n in some:
        own.setdefault(c, set()).add(n)
    literal = values.sparkSession.createDataFrame([(x, c) for c, n in entries.items() for x in {c, n}], "value string, c string")
    exact = values.groupBy("value").count().join(F.broadcast(literal), "value")  # two rows an entry, at most MAX_ENTRIES entries
    frequency = {r[0]: r[1] for r in exact.groupBy("c").agg(F.sum("count")).collect()}  # one row an entry
    return map_values(values, Dictionary(entries, own, frequency, formal=formal, short=short))


def map_by_join(values: DataFrame, listed: DataFrame, aliases: dict[str, set[str]], formal: frozenset[str], short: dict[str, str]) -> DataFrame:
    """values(record_id, value) -> (record_id, code) by listed(code, name) of any size: deletions of both are joined.

    Distinct values are looked up step by step as ``Dictionary`` does: as they stand, in their forms, by parts that agree, and
    by the deletions of each form; their codes are joined back.
    """
    area, spark = scratch(values.sparkSession), values.sparkSession

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            df["key"] = df["text"].map(fold).astype(object)
            df["lower"] = df["code"].map(str.casefold).astype(object)
            yield df

    further = spark.createDataFrame([(c, x) for c, names in aliases.items() for x in names], "code string, text string")  # the caller's list
    further = further.unionByName(listed.select("code", F.col("name").alias("text")))
    shape = "code string, text string, key string, lower string"
    entries = area.table(listed.groupBy("code").agg(F.min("name").alias("text")).mapInPandas(folded, shape), "entries")
    main = entries.where("key <> ''").groupBy("key").agg(F.min("code").alias("code")).withColumn("main", F.lit(True))
    also = further.mapInPandas(folded, shape).where("key <> ''").groupBy("key").agg(F.count_distinct("code").alias("n"), F.min("code").alias("code")).where("n = 1").join(main, "key", "left_anti")
    names = area.table(main.unionByName(also.select("key", "code", F.lit(False).alias("main"))), "names")
    exact = names.select("key", "code", F.lit(1).alias("r")).unionByName(entries.groupBy(F.col("lower").alias("key")).agg(F.min("code").alias("code")).withColumn("r", F.lit(0)))
    exact = area.table(exact.groupBy("key").agg(F.min_by("code", "r").alias("code")), "exact")  # codes come first
    longest = names.agg(F.max(F.length("key"))).first()[0] or 0

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(text, part, at, key): the whole value is part 0, its parts follow; at 0 as it stands, then its forms."""
        for df in batches:
            rows = []
            for text in df["text"]:
                if not stands_in(text):
                    parts = parts_of(text)
                    for p, x in enumerate([text, *(parts if len(parts) > 1 else [])]):
                        key = fold(x)
                        rows += [(text, p, at, k) for k, at in {k: at for at, k in reversed(list(enumerate([key, *forms_of(key, formal, short)])))}.items() if k]
            yield pd.DataFrame(rows, columns=["text", "part", "at", "key"]).astype({"part": "int32", "at": "int32"})

    typed = area.table(values.groupBy(F.col("value").alias("text")).agg(F.count(F.lit(1)).alias("n")), "typed")
    keys = area.table(typed.select("text").mapInPandas(tried, "text string, part int, at int, key string"), "forms")
    hits = keys.join(exact, "key").groupBy("text", "part").agg(F.min_by("code", "at").alias("code"))
    hits = hits.groupBy("text").agg(F.max(F.when(F.col("part") == 0, F.col("code"))).alias("whole"), F.min(F.when(F.col("part") > 0, F.col("code"))).alias("low"), F.max(F.when(F.col("part") > 0, F.col("code"))).alias("high"))
    told = area.table(hits.select("text", F.coalesce("whole", F.when(F.col("low") == F.col("high"), F.col("low"))).alias("code")).where("code is not null"), "told")
    literal = entries.select("code", F.explode(F.array_distinct(F.array("code", "text"))).alias("text"))
    frequency = typed.join(literal, "text").groupBy("code").agg(F.sum("n").alias("often"))

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            df["part"] = [list(deletions(k, 2)) for k in df["key"]]
            yield df.explode("part")[["key", "part"]]

    def entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            df["part"] = [list(deletions(k, d)) if (d := bound_of(k, m)) else [] for k, m in zip(df["name"], df["main"])]
            yield df.explode("part").dropna(subset=["part"])[["name", "code", "main", "part"]]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            d = [typo_distance(k, n, bound_of(n, m)) for k, n, m in zip(df["key"], df["name"], df["main"])]
            ok = [x is not None for x in d]
            yield df[ok].assign(edits=[x[0] + (not m) * 0.5 for x, m in zip(d, df["main"]) if x], cost=[x[1] for x in d if x])[["key", "code", "edits", "cost"]]

    open_ = keys.where((F.col("part") == 0) & (F.length("key") <= longest + 2)).join(told, "text", "left_anti").select("text", "at", "key")
    parts = open_.select("key").distinct().mapInPandas(looked_up, "key string, part string").join(names.withColumnRenamed("key", "name").mapInPandas(entered, "name string, code string, main boolean, part string"), "part")
    met = parts.select("key", "name", "code", "main").distinct().mapInPandas(near, "key string, code string, edits double, cost double")
    best = met.join(frequency, "code", "left").groupBy("key").agg(F.min_by("code", F.struct("edits", "cost", -F.coalesce("often", F.lit(0)), "code")).alias("code"))
    found = told.unionByName(area.table(open_.join(best, "key").groupBy("text").agg(F.min_by("code", "at").alias("code")), "best"))
    return values.join(found.withColumnRenamed("text", "value"), "value", "left").select("record_id", F.coalesce("code", F.lit(UNMATCHED)).alias("code"))
