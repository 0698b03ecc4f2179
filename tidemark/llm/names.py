"""Variant spellings of names typed by people: pigeonhole segment join, verified by banded edit distance.

Two words within k edits share one of any k + 1 segments of the one, shifted by at most k places in the other; an
exchange of neighbours across a cut touches two segments, so words are also looked up with such neighbours exchanged back.  Words of
names (given names, surnames, words of firms) are cut into k + 1 segments that fill an inverted index; the position
shifted substrings of other words are looked up in it, and what meets is verified by an edit distance that only fills a
band of the table.  Index and lookups live inside contexts - a contact value, a place, a date of birth that two records
have in common - since in a large population a name alone says little.  The index is keyed by context and segment: the
part of a context that fits one block is kept in that block; larger contexts are spread by a shuffle over their words and
the similar ones, which an index of all their distinct words finds (see ``blocks``).  Index, lookups and verification are
the same, and so are the pairs.

Which of the linked names are one entity is told by the comparison and the calibrated model of ``people``, which also
knows initials, short names, changed surnames and namesakes.

Edge cases: records without a word of three letters link nothing; equal names are no variants; names are compared as
written, so a blank or a letter's case makes a variant; repeated records count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.address import apart
from tidemark.llm.blocks import SPREAD, Block, all_pairs, compared, hopeful_pairs
from tidemark.llm.people import arrow, joined_before, learn, letters, named, profiles, scored, texts
from tidemark.session import broadcast_small, scratch

FEW = 30  # rows of a block whose pairs are looked at one by one; the index finds the same

def bound(size: int) -> int:
    """Edits allowed for a word of a length."""
    return 1 if size < 6 else 2


@lru_cache(20_000)
def segments(word: str) -> tuple[tuple[int, int, int, str], ...]:
    """(length, number, place, text) of the k + 1 segments of a word."""
    n, parts = len(word), bound(len(word)) + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return tuple((n, i, cuts[i], word[cuts[i] : cuts[i + 1]]) for i in range(parts))


@lru_cache(20_000)
def lookups_of(word: str, size: int) -> tuple[tuple[int, str], ...]:
    """(number, text) of the substrings by which a word of a length, no longer than this one, may be met within k edits."""
    n, k, out = len(word), bound(size), set()
    if not 3 <= size <= n or n - size > k:
        return ()
    parts = k + 1
    cuts = [i * size // parts for i in range(parts + 1)]
    for i in range(parts):
        width = cuts[i + 1] - cuts[i]
        # a segment can't be shifted further than the edits before it and those after it allow
        for at in range(max(0, cuts[i] - i, cuts[i] + n - size - (k - i)), min(n - width, cuts[i] + i, cuts[i] + n - size + (k - i)) + 1):
            out.add((i, word[at : at + width]))
    # an exchange at a cut, undone, leaves at most one other edit, so places shift by no more than the lengths differ
    for p in {c + s for c in cuts[1:-1] for s in range(n - size + 1)} if n - size < k else ():
        back = word[: p - 1] + word[p : p + 1] + word[p - 1] + word[p + 1 :]
        for i in range(parts):
            for at in range(cuts[i], cuts[i] + n - size + 1):
                end = at + cuts[i + 1] - cuts[i]
                if at <= p < end or at <= p - 1 < end:  # other places are looked up above
                    out.add((i, back[at:end]))
    return tuple(out)


def lookups(word: str) -> list[tuple[int, int, str]]:
    """(length, number, text) of the substrings by which an equally long or shorter word within k edits may be met."""
    return [(size, i, text) for size in range(max(3, len(word) - 2), len(word) + 1) for i, text in lookups_of(word, size)]


@lru_cache(50_000)
def within(a: str, b: str, k: int) -> bool:
    """Whether two words are within k edits, exchanged neighbours counting one; only a band of 2k + 1 is filled."""
    if abs(len(a) - len(b)) > k:
        return False
    a, b = apart(a, b)
    n, m = len(a), len(b)
    if not n or not m:
        return n + m <= k
    far = k + 1
    before, last = [far] * (m + 1), list(range(m + 1))
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        if i <= k:
            row[0] = i
        for j in range(max(1, i - k), min(m, i + k) + 1):
            best = min(last[j - 1] + (a[i - 1] != b[j - 1]), last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before[j - 2] + 1)
            row[j] = best
        if min(row) > k:
            return False
        before, last = last, row
    return last[m] <= k


def similar(a: str, b: str) -> bool:
    """Whether two words are within the edits of the shorter; lengths and letters rule most pairs out at once."""
    k = 1 if len(a) < 6 or len(b) < 6 else 2
    return -k <= len(a) - len(b) <= k and (letters(a) ^ letters(b)).bit_count() <= 2 * k and within(a, b, k)


def alike(words: list[str], length: np.ndarray, mask: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether words are equal or ``similar``, by their numbers: lengths and letters of all at once, edits of what is left."""
    ok = p == q
    k = np.where(np.minimum(length[p], length[q]) < 6, 1, 2)
    near = np.flatnonzero(~ok & (np.abs(length[p] - length[q]) <= k) & (np.bitwise_count(mask[p] ^ mask[q]) <= 2 * k))
    pair, which = np.unique(np.minimum(p, q)[near] << 32 | np.maximum(p, q)[near], return_inverse=True)
    ok[near] = np.array([similar(words[v], words[w]) for v, w in zip((pair >> 32).tolist(), (pair & (1 << 32) - 1).tolist())], dtype=bool)[which]
    return ok


def shared_word(block: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a word of the one name of each pair is similar to one of the other, as ``share_a_word`` says."""
    x, y = block.numbers[:, block.who[i]], block.numbers[:, block.who[j]]
    ok = np.zeros(len(i), bool)
    for v in x:
        for w in y:
            ok |= (v == w) & (v >= 0)
    for v in x:
        for w in y:
            left = np.flatnonzero(~ok & (v >= 0) & (w >= 0))
            ok[left] = alike(block.words, block.length, block.mask, v[left], w[left])
    left = np.flatnonzero(~ok & (block.further[block.who[i]] | block.further[block.who[j]]))
    ok[left] = [share_a_word(block.names[p], block.names[q]) for p, q in zip(block.who[i[left]].tolist(), block.who[j[left]].tolist())]
    return ok


@lru_cache(50_000)
def words_of(who: str) -> list[str]:
    """The words of a name that are looked up."""
    _, given, _, rest = named(who)
    return [w for w in dict.fromkeys([given, *rest.split()]) if len(w) > 2]


@lru_cache(50_000)
def share_a_word(who: str, other: str) -> bool:
    """Whether a word of the one name is similar to one of the other."""
    x, y = words_of(who), words_of(other)
    for v in x:
        if v in y:
            return True
    for v in x:
        for w in y:
            if similar(v, w):
                return True
    return False


@lru_cache(50_000)
def _entries(word: str) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a word in the index, and those by which it looks others up."""
    number = lambda size, i, text: hash((size, i, text))  # noqa: E731, within one task only
    return np.array([number(size, i, text) for size, i, _, text in segments(word)], np.int64), np.array([number(*x) for x in lookups(word)], np.int64)


def met(words: list[str], place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of word occurrences that meet in the inverted index keyed by context and segment: (holds it, looks it up)."""
    entries = [_entries(words[p]) for p in place.tolist()]
    own, ask = [x for x, _ in entries], [y for _, y in entries]
    salt = group.astype(np.int64) * np.int64(-7046029254386353131)
    at, by = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.repeat(np.arange(len(ask)), [len(x) for x in ask])
    held, asked = np.concatenate(own) ^ salt[at], np.concatenate(ask) ^ salt[by]
    order = np.argsort(held, kind="stable")
    held, at = held[order], at[order]
    keys, first, many = np.unique(held, return_index=True, return_counts=True)
    where = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[where] == asked
    where, by = where[hit], by[hit]
    n = many[where]
    return at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[where], n)], np.repeat(by, n)


@lru_cache(50_000)
def meets_first(v: str, w: str, number: int) -> bool:
    """Whether no segment of ``v`` before this one is among the lookups of ``w``, so that the two meet here for the first time."""
    return number == 0 or not {(i, text) for _, i, _, text in segments(v) if i < number} & set(lookups_of(w, len(v)))


def pairs_of(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the pairs of blocks that have different names and a similar word in them."""
    if block.kind[0] == SPREAD:  # one word of a spread context: who has it meets whose name has it or a similar one
        asks = block.batch.column("asks").to_numpy(zero_copy_only=False)
        for i, j in hopeful_pairs(block):
            ok = ~(asks[i] & asks[j]) & (block.nm[i] != block.nm[j])
            yield i[ok], j[ok]
        return
    large = (block.sizes > FEW)[block.group]
    few = np.flatnonzero(~large)
    for i, j in all_pairs(block.first[few], few):  # each pair by itself
        ok = block.nm[i] != block.nm[j]
        i, j, _, _ = block.possible(i[ok], j[ok], False)
        ok = shared_word(block, i, j)
        yield i[ok], j[ok]
    rows = np.flatnonzero(large)
    for lo in range(0, len(rows), 5_000):  # blocks that begin in this part of the rows
        part = rows[lo : lo + 5_000]
        first, last = block.group[part[0]], block.group[part[-1]]
        own = rows[(block.group[rows] >= first + (lo > 0 and block.group[rows[lo - 1]] == first)) & (block.group[rows] <= last)]
        if not len(own):
            continue
        number: dict[str, int] = {}
        name, which = np.unique(block.who[own], return_inverse=True)
        held = [[number.setdefault(w, len(number)) for w in words_of(block.names[x])] for x in name.tolist()]
        size = np.array([len(x) for x in held])
        flat, begin, n = np.array([p for x in held for p in x], np.int64), (np.cumsum(size) - size)[which], size[which]
        row = np.repeat(own, n)
        place = flat[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        if not len(place):
            continue
        # one entry for each word of a block, whoever has it
        entry, which = np.unique(block.group[row] * np.int64(len(number)) + place, return_inverse=True)
        words = list(number)
        i, j = met(words, entry % len(number), entry // len(number))
        pair = np.unique(np.minimum(i, j) << 32 | np.maximum(i, j))
        i, j = pair >> 32, pair & ((1 << 32) - 1)
        p, q = (entry % len(number))[i], (entry % len(number))[j]
        ok = alike(words, np.array([len(w) for w in words]), np.array([letters(w) for w in words], np.int64), p, q)
        i, j = i[ok], j[ok]
        order = np.argsort(which, kind="stable")
        begin, end = np.searchsorted(which[order], np.arange(len(entry))), np.searchsorted(which[order], np.arange(len(entry)), "right")
        many = row[order]
        # the rows that have the one word with those that have the other
        nx, ny = (end - begin)[i], (end - begin)[j]
        each = nx * ny
        at = np.repeat(np.arange(len(i)), each)
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        x, y = many[begin[i][at] + k // ny[at]], many[begin[j][at] + k % ny[at]]
        ok = block.nm[x] != block.nm[y]
        pairs = np.unique(np.minimum(x, y)[ok] << 32 | np.maximum(x, y)[ok])
        yield pairs >> 32, pairs & ((1 << 32) - 1)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of contexts too large for a block, once for each word of their names, and once more for each similar word of
    others, of which the later asks.  The index of segments is joined over the distinct words."""
    area, shape = scratch(rows.sparkSession), "word string, number int, part string, mask long"

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(who) for who in texts(batch.column("who"))]
            out = batch.take(pa.array(np.repeat(np.arange(len(words)), [len(x) for x in words])))
            yield out.set_column(out.schema.get_field_index("sub"), "sub", pa.array([w for x in words for w in x], pa.string()))

    def indexed(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [(w, i, f"{size}:{i}:{text}", mask) for w, mask in ((w, letters(w)) for w in texts(batch.column("sub"))) for size, i, text in keys_of(w)]
            yield arrow(dict(zip(("word", "number", "part", "mask"), zip(*each) if each else ((), (), (), ()))), shape)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(texts(batch.column("word")), texts(batch.column("other")), batch.column("number").to_numpy().tolist())
            yield batch.filter(pa.array([similar(v, w) and meets_first(v, w, i) for v, w, i in pairs], pa.bool_()))

    own = area.table(rows.mapInArrow(held, rows.schema).withColumn("asks", F.lit(False)), "held")
    words = area.table(own.select("sub").distinct(), "words")
    entries = words.mapInArrow(lambda b: indexed(b, lambda w: ((n, i, text) for n, i, _, text in segments(w))), shape)
    asked = words.mapInArrow(lambda b: indexed(b, lookups), shape).select(F.col("word").alias("other"), "part", F.col("mask").alias("letters"))
    few = F.bit_count(F.col("mask").bitwiseXOR(F.col("letters"))) <= F.when(F.least(F.length("word"), F.length("other")) < 6, 2).otherwise(4)
    near = entries.join(asked, "part").where(few & (F.col("word") != F.col("other"))).select("word", "other", "number").mapInArrow(close, "word string, other string, number int")
    near = area.table(near.select(F.least("word", "other").alias("first"), F.greatest("word", "other").alias("sub")).distinct(), "near")
    asks = own.join(broadcast_small(near), "sub").withColumns({"sub": F.col("first"), "asks": F.lit(True)})
    return own.unionByName(asks.select(own.columns))


def link_names(a: DataFrame, b: DataFrame, golden: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id1, id2, probability) of records that name one entity differently."""
    codes = compared(profiles(a, b), pairs_of, spread, differ=True).where("differ")
    return scored(codes, learn(codes, joined_before(golden)), threshold).select("id1", "id2", "probability")
