"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment.

Every passage gives word n-grams.  Its seeds are its rarest ones: those that at most COMMON passages hold and, where these
cover less than COVER of its n-grams, the next rarer ones up to that share, so that every passage has seeds in every part
of it, also one that is contained in others.  A record that holds a seed is a candidate for each passage that has it, with
the words around its seeds.  Every candidate is aligned word by word, however many records hold its seeds; equal windows
of a batch are aligned once.  Matches gain, altered, dropped and added words cost, and one insertion of other text of any
length is free.  A pair counts when the aligned stretch covers the wanted share of the passage with few enough edits.

Words are compared without letter case, accents, punctuation and layout; words that a line end divides are joined.

The passages are shipped to the tasks in parts of at most PART items, so their size in memory has a bound whatever the
number of passages; records are scanned where they lie and only candidates are shuffled.

Edge cases: null and empty texts and passages match nothing; passages shorter than a seed are found where their whole
word row stands; repeated records and items count once; equal passages are all reported.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.session import scratch

GRAM, PART = 3, 20_000
COMMON, COVER = 1, 0.5
_DIVIDED = re.compile(r"(?<=[^\W\d_])[-­‐]\s*\n[\s#>|*/]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[̀-ͯ­​-‍﻿]+")
_FAR = -(10**9)


def words(text: str | None) -> list[str]:
    """The words of a text, folded."""
    if not text:
        return []
    if "-" in text or not text.isascii():
        text = _DIVIDED.sub("", text)
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text)


class Seeds:
    """Word numbers and seed n-grams of a part of the passages."""

    def __init__(self, items: list[tuple[int, str]], gram: int = GRAM):
        self.gram, self.vocabulary = gram, {}
        self.passages: dict[int, np.ndarray] = {}
        for i, text in items:
            row = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if row:
                self.passages[i] = np.array(row, dtype=np.int64)
        self.base = np.uint64(len(self.vocabulary) + 2)
        rows = {tuple(p): [] for p in self.passages.values()}
        for i, p in self.passages.items():
            rows[tuple(p)].append(i)
        self.first = {ids[0]: ids for ids in rows.values()}  # equal passages share seeds
        # passages of fewer words than a seed by their length, whole
        self.short = {n: {row: ids[0] for row, ids in rows.items() if len(row) == n} for n in {len(r) for r in rows} if n < gram}
        own = {i: np.unique(self.keys(self.passages[i])) for i in self.first if len(self.passages[i]) >= gram}
        every, held = np.unique(np.concatenate([*own.values(), np.zeros(0, np.uint64)]), return_counts=True)
        seeds = []
        for i, keys in own.items():
            n = held[np.searchsorted(every, keys)]
            order = np.argsort(n, kind="stable")
            few = max(int((n <= COMMON).sum()), -(-int(COVER * 100) * len(keys) // 100))
            seeds.append((keys[order[:few]], i))
        key = np.concatenate([*(k for k, _ in seeds), np.zeros(0, np.uint64)])
        owner = np.concatenate([*(np.full(len(k), i, np.int64) for k, i in seeds), np.zeros(0, np.int64)])
        order = np.argsort(key, kind="stable")
        self.owner = owner[order]
        self.key, self.start, self.count = np.unique(key[order], return_index=True, return_counts=True)

    def keys(self, row: np.ndarray) -> np.ndarray:
        """The number of every n-gram of a row; 0 where a word is unknown."""
        n = len(row) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(self.gram):
            part = row[k : k + n]
            out = out * self.base + part.astype(np.uint64)
            known &= part > 0
        return np.where(known, out, np.uint64(0))

    def rows(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, w := words(text), repeat(0)), dtype=np.int64, count=len(w))

    def hits(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the row, passage) of the seeds in it."""
        places, owners = [], []
        key = self.keys(row)
        if len(key) and len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            place = np.flatnonzero((self.key[at] == key) & (key > 0))
            at = at[place]
            n = self.count[at]
            places.append(np.repeat(place, n))
            owners.append(self.owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)])
        for n, passages in self.short.items():
            found = [(i, passages[w]) for i in range(len(row) - n + 1) if (w := tuple(row[i : i + n].tolist())) in passages]
            places.append(np.array([i for i, _ in found], np.int64))
            owners.append(np.array([p for _, p in found], np.int64))
        return (np.concatenate(places), np.concatenate(owners)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def align(passage: np.ndarray, text: np.ndarray, cost: int = 2) -> tuple[int, int]:
    """(matched words, edits) of the best local alignment with at most one free insertion of other text.

    A match gains 1, an altered, dropped or added word costs ``cost``, the free insertion costs ``cost`` once and counts
    as one edit.  Scores hold the matches in their low bits, so that no trace has to be kept.
    """
    unit = 1 << 24
    gain, lose = unit + 1, cost * unit
    n = len(text)
    steps = np.arange(n + 1, dtype=np.int64) * lose
    h, g = np.zeros(n + 1, np.int64), np.full(n + 1, _FAR, np.int64)
    best = 0
    for w in passage:
        score = np.where(text == w, gain, -lose)
        over = np.maximum.accumulate(h)  # the best end so far, wherever the insertion starts
        new = np.maximum(h - lose, 0)
        new[1:] = np.maximum(new[1:], h[:-1] + score)
        new = np.maximum.accumulate(new + steps) - steps  # added words
        jump = g - lose
        jump[1:] = np.maximum(jump[1:], np.maximum(g[:-1], over[:-1] - lose) + score)
        jump = np.maximum.accumulate(jump + steps) - steps
        h, g = new, jump
        best = max(best, int(h.max()), int(g.max()))
    matched = best & (unit - 1)
    return matched, (matched - (best >> 24)) // cost


def _candidates(seeds_of):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds: Seeds = seeds_of()
        for df in batches:
            out = []
            for d, text in zip(df["doc_id"], df["text"]):
                row = seeds.rows(text)
                place, owner = seeds.hits(row)
                if not len(place):
                    continue
                order = np.argsort(owner, kind="stable")
                place, owner = place[order], owner[order]
                begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                for i, first, last in zip(owner[begin].tolist(), np.minimum.reduceat(place, begin).tolist(), np.maximum.reduceat(place, begin).tolist()):
                    size = 2 * len(seeds.passages[i])
                    out.append((d, i, row[max(0, first - size) : last + size].astype(np.int32).tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "item", "row"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, share: float = 0.5, edits: float = 0.2, slack: int = 2) -> DataFrame:
    """(doc_id, item_id, matched, n_edits, n_words) of docs(doc_id, text) that hold a passage of items(item_id, passage).

    The aligned stretch covers at least ``share`` of the passage's words, less ``slack`` words that an edit at its ends
    can hide, with at most ``edits`` of it altered, dropped or added, one for the free insertion and one at an end apart.
    """
    spark = docs.sparkSession
    area = scratch(spark)
    parts = max(1, -(-items.count() // PART))
    found = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else items
        rows = [(r["item_id"], r["passage"]) for r in own.select("item_id", "passage").distinct().collect()]  # at most some PART items
        shipped = spark.sparkContext.broadcast(Seeds(rows))
        scan = docs.select("doc_id", "text").where("text <> ''").mapInPandas(_candidates(lambda s=shipped: s.value), "doc_id long, item long, row array<int>")
        hits = area.table(scan, "candidates")

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            seeds: Seeds = shipped.value
            for df in batches:
                out, done = [], {}
                for d, i, row in zip(df["doc_id"], df["item"], df["row"]):
                    passage, row = seeds.passages[i], np.asarray(row, dtype=np.int64)
                    if (key := (i, row.tobytes())) not in done:
                        done[key] = align(passage, row)
                    matched, changed = done[key]
                    stretch = matched + changed
                    if stretch >= share * len(passage) - slack and changed <= edits * stretch + 2:
                        out += [(d, same, matched, changed, len(passage)) for same in seeds.first[i]]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "matched", "n_edits", "n_words"])

        hit = hits.mapInPandas(run, "doc_id long, item_id long, matched int, n_edits int, n_words int")
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "n_edits", "n_words")).alias("m")).select("doc_id", "item_id", "m.*")
