"""Candidate blocks: records that share a context are compared where the shuffle brings them together.

A record goes, with its whole profile, to each of its contexts (see ``people``); a block is compared in one task, so no
list of pairs is shuffled or joined with profiles again.  Contexts of at most ``gather`` rows are blocks by themselves.
Those of more rows are spread over finer keys where there are any (words of names), and where a key is as
large again, its rows are salted into chunks that meet two by two, so that no block has more than some ``gather`` rows,
whatever a value's share of the data is.  How large a context is decides where its pairs meet, not which.

A pair is compared in the first block of a context that both records have, in the order of KINDS; spread contexts
come last and may meet a pair several times, of which one is kept.  Whole batches of blocks are compared at once, field by
field; only names that could make a candidate of a pair are looked at one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.people import CODES, HOPELESS, KINDS, NAME, NICKNAMED, PRIOR, PROFILE, SHORT_FORMS, arrow, hopeful, letters, marked, name_code, named, texts
from tidemark.session import broadcast_small, scratch

GATHER = 5000
#: Of blocks of at most so many rows, the pairs that differ in all letters are counted by code, as information.
COUNTED = 30
#: What a row of a block holds, numbers with 0 for null; sub, asks and chunk stand on rows of spread contexts.
ROW = PROFILE + ", bits int, key long"
SPREAD_ROW = ROW + ", sub string, asks boolean, chunk int"
OUT = "id1 string, id2 string, code string, differ boolean, across boolean, n long"
SPREAD = 7  # the kind of rows of spread contexts
_WORDS, _STEP = 3, 60_000  # words of a surname that are compared by their letters; pairs that are looked at together
_LONG = 12 + 2 * _WORDS  # where traits have lengths


def traits(names: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Of each name, in a column of its own: initial, whether it is a person's with some words, first letters and letters of given
    name and surnames, whether they are short forms, letters of its words, whether there are further words, whether any is a
    short form, numbers of given name and words in the list that is returned too, lengths of given name, surnames and words,
    whether it may have an umlaut written with e, whether it is a firm's. Letters are those of ``letters``, with a bit that no
    letter has for words under six; -1 where there is no word, or none of three letters."""
    n = len(names)
    codes = np.frombuffer((NAME.join([*texts(names), ""])).encode("utf-32-le"), np.uint32)
    cut, blank = codes == ord(NAME), codes == ord(" ")
    ends = np.flatnonzero(cut)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    size = (ends - starts).reshape(n, 4).T
    head = np.where(size > 0, codes[starts].reshape(n, 4).T, 0).astype(np.int64)
    bits = np.where(cut, 0, np.int64(1) << (codes % 61).astype(np.int64))
    short = lambda k: (k < 6).astype(np.int64) << 62
    field = np.bitwise_or.reduceat(bits, starts).reshape(n, 4).T if n else np.zeros((4, 0), np.int64)
    # words of the surnames: what stands between blanks
    part = np.cumsum(cut) - cut
    inside = (part & 3 == 3) & ~cut & ~blank
    begin = np.flatnonzero(inside & ~np.append(False, inside[:-1])[: len(inside)])
    of = part[begin] >> 2
    many = np.bincount(of, minlength=n)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    words, long = np.full((_WORDS, n), -1, np.int64), np.zeros((_WORDS, n), np.int64)
    umlaut = (codes == ord("e")) & np.append(False, np.isin(codes[:-1], [ord(c) for c in "aou"]))[: len(codes)]
    umlaut = np.bincount(part[umlaut] >> 2, minlength=n) > 0
    if len(begin):
        kept = rank < _WORDS
        length = np.add.reduceat(inside.astype(np.int64), begin)
        mask = np.bitwise_or.reduceat(np.where(inside, bits, 0), begin) | short(length)
        words[rank[kept], of[kept]], long[rank[kept], of[kept]] = mask[kept], length[kept]
    firm = head[0] == ord("F")
    fields = pc.list_flatten(pc.split_pattern(names, NAME))
    known = lambda k, values: pc.is_in(fields.take(pa.array(np.arange(n) * 4 + k)), value_set=pa.array(sorted(values))).to_numpy(zero_copy_only=False)
    plain = ~firm & (many > 0) & (many <= _WORDS)
    whole = np.where(many == 1, words[0], field[3] | short(size[3]))
    listed = (known(1, SHORT_FORMS), known(3, SHORT_FORMS), known(1, NICKNAMED))
    each = pc.list_flatten(pc.split_pattern(fields.take(pa.array(np.arange(n) * 4 + 3)), " "))
    each = pa.concat_arrays([fields.take(pa.array(np.arange(n) * 4 + 1)), each.filter(pc.not_equal(each, ""))]).dictionary_encode()
    number, short_form = each.indices.to_numpy().astype(np.int64), pc.is_in(each.dictionary, value_set=pa.array(sorted(SHORT_FORMS))).to_numpy(zero_copy_only=False)
    any_short = short_form[number[:n]] | (np.bincount(of, short_form[number[n:]], minlength=n) > 0)
    number = np.where(pc.utf8_length(each.dictionary).to_numpy()[number] > 2, number, -1)
    numbers = np.full((_WORDS, n), -1, np.int64)
    if len(begin):
        numbers[rank[kept], of[kept]] = number[n:][kept]
    columns = (head[2], plain, head[1], head[3], field[1] | short(size[1]), whole, *listed, *words, many > _WORDS, any_short, number[:n], *numbers, size[1], size[3], *long, umlaut, firm)
    return np.stack([x.astype(np.int64) for x in columns]), texts(each.dictionary)


#: The letters that a short form has for itself, in its ending, are left out of these bits.
_STEM = (1 << 62) - 1 & ~letters("iey")


def all_pairs(first: np.ndarray, rows: np.ndarray, most: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of these rows with the rows from its ``first`` one on to itself, or ``most`` of them, some _STEP pairs at a time."""
    before = rows - first if most is None else np.minimum(rows - first, most)
    ends = np.cumsum(before)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _STEP)))
        n = before[lo:hi]
        j = np.repeat(rows[lo:hi], n)
        yield np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[lo:hi], n), j
        lo = hi


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where the run of equal values of each place begins."""
    new = np.append(True, sorted_values[1:] != sorted_values[:-1])[: len(sorted_values)]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class _Gathered(dict):
    def __init__(self, values: np.ndarray, at: np.ndarray):
        self.values_, self.at = values, at

    def __missing__(self, k: int) -> np.ndarray:
        self[k] = self.values_[k][self.at]
        return self[k]


class Block:
    """Rows of complete blocks as arrays: number, kind and first row of each row's block, and the rows' values."""

    def __init__(self, batch: pa.RecordBatch, keys: np.ndarray):
        self.first = runs(keys)
        self.starts, self.group = np.unique(self.first, return_inverse=True)
        self.sizes = np.diff(np.append(self.starts, len(keys)))
        self.kind = keys & 7
        self.batch = batch
        for name in "nm local email phone dob place town bits".split():
            setattr(self, name, batch.column(name).to_numpy())
        self.a = batch.column("a").to_numpy(zero_copy_only=False)
        ids = batch.column("record_id").dictionary_encode()
        self.id = ids.indices.to_numpy()
        who = batch.column("who").dictionary_encode()
        self.names, self.who = texts(who.dictionary), who.indices.to_numpy()
        self.traits, self.words = traits(who.dictionary)
        self.further, self.numbers = self.traits[9 + _WORDS] != 0, self.traits[11 + _WORDS : 12 + 2 * _WORDS]
        self.length, self.mask = np.array([len(w) for w in self.words]), np.array([letters(w) for w in self.words], np.int64)
        self.chunk = None
        if "chunk" in batch.schema.names:
            self.chunk = batch.column("chunk").fill_null(-1).to_numpy()
            self.chunk_first, self.chunk_last = np.minimum.reduceat(self.chunk, self.starts), np.maximum.reduceat(self.chunk, self.starts)
        month, day = self.dob // 100 % 100, self.dob % 100
        self.flipped = self.dob // 10000 * 10000 + np.minimum(month, day) * 100 + np.maximum(month, day)

    def traits_of(self, i: np.ndarray) -> dict[int, np.ndarray]:
        """The traits of rows' names by their number, each gathered when asked for."""
        return _Gathered(self.traits, self.who[i])

    def met_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a context of an earlier kind, or for spread rows any that isn't spread, brings a pair together too."""
        out, spread, kind = np.zeros(len(i), bool), (self.bits[i] | self.bits[j]) >> 10, self.kind[i]
        for n, c in ((0, self.local), (2, self.phone), (3, self.place), (4, self.flipped)):
            out |= (kind > n) & (c[i] == c[j]) & (c[i] != 0) & (spread >> n & 1 == 0)
        return out

    def values(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The first four letters of the pairs' codes as one number each, see ``letters_of``."""
        b1, b2 = self.bits[i], self.bits[j]

        def code(c: np.ndarray, n: int, kind: str, otherwise: np.ndarray) -> np.ndarray:
            at = {x: CODES[kind].index(x) for x in CODES[kind]}
            busy = np.array([at["E"], at["H"], at["B"], at["B"]])
            known = np.where(c[i] == c[j], busy[b1 >> 2 * n & 3], np.where((b1 | b2) >> 2 * n & 3 != 0, at["M"], otherwise))
            return np.where((c[i] == 0) | (c[j] == 0), at["M"], known)

        at = lambda kind, x: CODES[kind].index(x)
        e = code(self.email, 1, "e", np.where((self.local[i] == self.local[j]) & ((b1 | b2) & 3 == 0), at("e", "L"), at("e", "X")))
        p = code(self.phone, 2, "p", at("p", "X"))
        place = code(self.place, 3, "l", np.where(self.town[i] == self.town[j], at("l", "T"), at("l", "X")))
        x, y = self.dob[i], self.dob[j]
        wrong = sum((x // 10**k % 10 != y // 10**k % 10).astype(np.int8) for k in range(8))
        turned = (x // 10000 == y // 10000) & (x // 100 % 100 == y % 100) & (x % 100 == y // 100 % 100)
        d = code(self.dob, 4, "d", np.where(turned, at("d", "S"), np.where(wrong == 1, at("d", "T"), at("d", "X"))))
        return ((e * 8 + p) * 8 + place) * 8 + d

    def apart(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of persons, whether given names, and whether surnames, are different by their letters alone, and whether
        they can't be exchanged."""
        x, y = self.traits_of(i), self.traits_of(j)
        short, bits = 1 << 62, (1 << 62) - 1
        # more letters that only one has than typing errors can explain, one for an umlaut, or other lengths where there is none
        umlaut = (x[-2] | y[-2]) != 0

        def far(p: np.ndarray, q: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
            some = (p | q) & short != 0
            return (np.bitwise_count((p ^ q) & bits) > np.where(some, 2, 4) + umlaut) | (~umlaut & (np.abs(m - n) > np.where(some, 1, 2)))

        # a short form has no letters of its own but for its ending
        cut = lambda p, q: (p & ~q & _STEM == 0) | (q & ~p & _STEM == 0)
        apart = lambda g, h, p, q, s, t, m, n: far(p, q, m, n) & (s == 0) & (t == 0) & ((g != h) | ~cut(p, q))
        both, plain = (x[2] != 0) & (y[2] != 0), (x[1] == 1) & (y[1] == 1)
        given = np.where(both, apart(x[2], y[2], x[4], y[4], x[6], y[6], x[_LONG], y[_LONG]), (x[0] != 0) & (y[0] != 0) & (x[0] != y[0]) & (x[8] == 0) & (y[8] == 0))
        turned = apart(x[2], y[3], x[4], y[5], x[6], y[7], x[_LONG], y[_LONG + 1]) | apart(x[3], y[2], x[5], y[4], x[7], y[6], x[_LONG + 1], y[_LONG])
        surname = plain.copy()
        for v in range(_WORDS):
            for w in range(_WORDS):
                surname &= (x[9 + v] < 0) | (y[9 + w] < 0) | far(x[9 + v], y[9 + w], x[_LONG + 2 + v], y[_LONG + 2 + w])
        return plain & given, surname, plain & (turned | ~both)

    def unlike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of persons whose given names and surnames are different by their letters alone, also if exchanged."""
        given, surname, unturned = self.apart(i, j)
        return given & surname & unturned

    def firms_apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs with a firm, whether so few words are alike by their letters that the names are different, or for a firm and
        a person no more than partly the same."""
        x, y = self.traits_of(i), self.traits_of(j)
        short, bits, given = 1 << 62, (1 << 62) - 1, (x[-1] & y[-1]) == 0
        columns = (4, *range(9, 9 + _WORDS))
        held = [[(z[2] != 0) & given if v == 4 else z[v] >= 0 for v in columns] for z in (x, y)]
        met = [[np.zeros(len(i), bool) for _ in columns] for _ in "xy"]
        for a, v in enumerate(columns):
            for b, w in enumerate(columns):
                p, q = x[v], y[w]
                ok = np.bitwise_count((p ^ q) & bits) <= np.where((p | q) & short != 0, 3, 5)
                ok |= (p & ~q & _STEM == 0) | (q & ~p & _STEM == 0)
                ok &= held[0][a] & held[1][b]
                met[0][a] |= ok
                met[1][b] |= ok
        (nx, ny), (mx, my) = (sum(z.astype(np.int64) for z in one) for one in held), (sum(z.astype(np.int64) for z in one) for one in met)
        enough = np.where(given, (mx == nx) & (my == ny) & (nx == ny), np.minimum(mx, my) >= 0.6 * np.maximum(nx, ny))
        unsure = (x[9 + _WORDS] | y[9 + _WORDS] | x[10 + _WORDS] | y[10 + _WORDS]) != 0
        return ~enough & ~unsure & (nx > 0) & (ny > 0)

    def most(self, i: np.ndarray, j: np.ndarray, given: np.ndarray, surname: np.ndarray) -> np.ndarray:
        """The most that the names of pairs add to their log-odds, where it is known which given names and surnames differ."""
        x, y = self.traits_of(i), self.traits_of(j)
        known, held = (x[2] != 0) & (y[2] != 0), (x[3] != 0) & (y[3] != 0)
        persons = np.where(given, PRIOR["gD"], np.where(known, _GIVEN, _INITIAL)) + np.where(surname, PRIOR["sD"], np.where(held, _SURNAME, PRIOR.get("sM", 0.0)))
        return np.where(x[-1] & y[-1], _FIRMS, np.where(x[-1] | y[-1], _BOTH, persons))

    def firms_most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same for pairs with a firm, by the letters of all words."""
        both = (self.traits[-1][self.who[i]] & self.traits[-1][self.who[j]]) != 0
        return np.where(self.firms_apart(i, j), np.where(both, _FIRMS_APART, _BOTH_APART), np.where(both, _FIRMS, _BOTH))

    def possible(self, i: np.ndarray, j: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
        """(rows, rows, values) of the pairs that are met first here and may be candidates, and counts of pairs by value."""
        ok = self.id[i] != self.id[j]
        if across:
            ok &= self.a[i] != self.a[j]
        i, j = i[ok], j[ok]
        new = ~self.met_before(i, j)
        i, j = i[new], j[new]
        value = self.values(i, j)
        given, surname, unturned = self.apart(i, j)
        unlike = given & surname & unturned
        told = unlike & (self.sizes[self.group[i]] <= COUNTED)
        number = ((value << 2) + (self.a[i] != self.a[j]) * 2 + (self.nm[i] != self.nm[j]))[told]
        ok = _VALUES[value] + self.most(i, j, given & unturned, surname & unturned) >= HOPELESS - 1e-9
        i, j, value = i[ok], j[ok], value[ok]
        firm = np.flatnonzero(self.traits[-1][self.who[i]] | self.traits[-1][self.who[j]])
        ok = np.ones(len(i), bool)
        ok[firm] = _VALUES[value[firm]] + self.firms_most(i[firm], j[firm]) >= HOPELESS - 1e-9
        return i[ok], j[ok], value[ok], dict(zip(*(x.tolist() for x in np.unique(number, return_counts=True))))


@lru_cache(5_000)
def letters_of(number: int) -> str:
    e, p, place, d = number >> 9, number >> 6 & 7, number >> 3 & 7, number & 7
    return CODES["e"][e] + CODES["p"][p] + CODES["l"][place] + CODES["d"][d]


#: Prior log-odds of the values of pairs by their number, without names, and the most that names add.
_VALUES = np.array([PRIOR["bias"] + sum(PRIOR.get(k + CODES[k][x], 0.0) if x < len(CODES[k]) else -99.0 for k, x in zip("epld", (v >> 9, v >> 6 & 7, v >> 3 & 7, v & 7))) for v in range(8**4)])
_GIVEN, _SURNAME = (max(PRIOR.get(k + x, 0.0) for x in CODES[k]) for k in "gs")
#: The same where a given name is missing, of two firms, and of a firm and a person, see ``name_code``.
_INITIAL = max(PRIOR.get("g" + x, 0.0) for x in "IMD")
_FIRMS = PRIOR.get("gM", 0.0) + _SURNAME + PRIOR["fF"]
_BOTH = max(PRIOR.get("gM", 0.0), PRIOR["gD"]) + _SURNAME + PRIOR["fB"]
_FIRMS_APART = PRIOR.get("gM", 0.0) + PRIOR["sD"] + PRIOR["fF"]
_BOTH_APART = PRIOR["gD"] + max(PRIOR["sC"], PRIOR["sD"]) + PRIOR["fB"]
assert max(_FIRMS, _BOTH) <= _GIVEN + _SURNAME  # so firms add no more than persons


#: Two different dates that are no misspelling of each other leave no chance to a pair without an equal value that isn't busy.
assert PRIOR["bias"] + PRIOR["dX"] + sum(max(PRIOR.get(k + x, 0.0) for x in CODES[k] if x not in "EL") for k in "epl") + _GIVEN + _SURNAME < HOPELESS


def hopeful_pairs(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of all pairs of spread blocks but of some whose dates leave them no chance; a few pairs come several times.

    A pair has a chance where a date is missing or busy, where dates are equal but for one digit or for day and month, or
    where a whole address is equal; other values that are equal and not busy have brought it together elsewhere, unless
    their contexts are spread too.
    """
    bits, dob = block.bits, block.dob.astype(np.int64)
    loose = (dob == 0) | (bits >> 8 & 3 != 0)
    for n in (0, 2, 3):
        loose |= (bits >> (10 + n) & 1 != 0) & (bits >> 2 * n & 3 == 0)
    # rows that may meet any other stand first in their block
    order = np.lexsort((~loose, block.group))
    held = np.add.reduceat(loose.astype(np.int64), block.starts)[block.group]
    for i, j in all_pairs(block.first, np.arange(len(order)), held):
        yield order[i], order[j]
    rows = np.flatnonzero(~loose)
    if len(rows) < 2:
        return
    day, block_of = dob[rows], block.group[rows].astype(np.int64) << 32
    keys = [block_of | (day - day // 10**p % 10 * 10**p) * 9 + p for p in range(8)]
    keys.append(block_of | block.flipped[rows].astype(np.int64) * 9 + 8)
    mail = np.unique(block.email[rows], return_inverse=True)[1]
    mailed = block.email[rows] != 0
    key, row = np.concatenate([*keys, (block_of | 9 * 10**8 + 9 + mail)[mailed]]), np.concatenate([*[rows] * 9, rows[mailed]])
    order = np.argsort(key, kind="stable")
    row, first = row[order], runs(key[order])
    for i, j in all_pairs(first, np.arange(len(row))):
        i, j = row[i], row[j]
        pair = np.unique(np.minimum(i, j) << 32 | np.maximum(i, j))
        yield pair >> 32, pair & (1 << 32) - 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of complete blocks of two and more rows, of a partition sorted by key."""
    rest = None

    def several(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        keys = batch.column("key").to_numpy()
        same = keys[1:] == keys[:-1]
        kept = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False)) if len(keys) > 1 else []
        if len(kept):
            yield batch.take(pa.array(kept)), keys[kept]

    for batch in batches:
        if rest is not None and rest.num_rows:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if batch.num_rows:
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from several(batch.slice(0, cut))
            rest = batch.slice(cut)
    if rest is not None:
        yield from several(rest)


def _comparer(pairs_of: Callable[[Block], Iterator[tuple[np.ndarray, np.ndarray]]], across: bool, differ: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[tuple[str, bool, bool], int] = defaultdict(int)
        for batch, keys in _runs(batches):
            a = batch.column("a").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
            kept = np.ones(len(keys), bool)
            if keys[0] & 7 != SPREAD:  # rows delivered twice
                ids = batch.column("record_id").dictionary_encode().indices.to_numpy()
                kept = np.zeros(len(keys), bool)
                kept[np.unique(group * (int(ids.max()) + 1) + ids, return_index=True)[1]] = True
            if across:
                n, own = np.add.reduceat(kept.astype(np.int64), starts), np.add.reduceat((a & kept).astype(np.int64), starts)
                kept &= ((own > 0) & (own < n))[group]
            if differ:  # blocks of one name
                nm = batch.column("nm").to_numpy()
                kept &= (np.minimum.reduceat(nm, starts) != np.maximum.reduceat(nm, starts))[group]
            if not kept.any():
                continue
            block = Block(batch.filter(pa.array(kept)), keys[kept])
            for i, j in pairs_of(block):
                for lo in range(0, len(i), _STEP):
                    yield _compare(block, i[lo : lo + _STEP], j[lo : lo + _STEP], across, counted)
        rows = [(None, None, *key, n) for key, n in counted.items()]
        names = [x.split()[0] for x in OUT.split(", ")]
        yield arrow(dict(zip(names, map(list, zip(*rows)) if rows else [[] for _ in names])), OUT)

    return run


def _compare(block: Block, i: np.ndarray, j: np.ndarray, across: bool, counted: dict) -> pa.RecordBatch:
    """The candidates among some pairs of rows; the others are left, or counted where they differ in all letters."""
    if block.chunk is not None:
        ok = (block.chunk_first == block.chunk_last)[block.group[i]] | (block.chunk[i] != block.chunk[j])
        i, j = i[ok], j[ok]
    i, j, value, told = block.possible(i, j, across)
    for number, n in told.items():
        if not hopeful(code := letters_of(number >> 2) + "DDP"):
            counted[code, bool(number & 1), bool(number & 2)] += n
    ids = block.batch.column("record_id")
    swap = ~block.a[i] if across else pc.greater(ids.take(pa.array(i)), ids.take(pa.array(j))).to_numpy(zero_copy_only=False)
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    names, pair = block.names, block.who[i].astype(np.int64) << 32 | block.who[j]
    pair, which = np.unique(pair, return_inverse=True)  # each two names are compared once
    told = [name_code(named(names[p]), named(names[q])) for p, q in zip((pair >> 32).tolist(), (pair & (1 << 32) - 1).tolist())]
    codes = [letters_of(v) + told[k] for v, k in zip(value.tolist(), which.tolist())]
    good = np.array([hopeful(c) for c in codes], dtype=bool)
    i, j = i[good], j[good]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(codes, pa.string()).filter(pa.array(good)), pa.array(block.nm[i] != block.nm[j]), pa.array(block.a[i] != block.a[j]), pa.array(np.ones(len(i), np.int64))], names=[x.split()[0] for x in OUT.split(", ")]
    )


def compared(people: DataFrame, pairs_of: Callable, spread: Callable, across: bool = False, gather: int = GATHER, differ: bool = False) -> DataFrame:
    """(*OUT), written tables, of the candidates among people that meet, each pair once, besides counts of others.

    ``pairs_of(block)`` gives the rows of pairs in blocks, ``spread(rows)`` fills sub and asks of rows of contexts that
    are too large to be a block.  With ``across`` only pairs of the two sources count, A's record first; with
    ``differ`` only pairs of different names.
    """
    area = scratch(people.sparkSession)
    own = [F.coalesce(n, F.lit(0)).alias(n) if t in ("int", "long") else F.col(n) for n, t in (x.split() for x in PROFILE.split(", "))]
    people, held, large = marked(people, gather)
    kinds = [(i, k) for i, k in enumerate(KINDS) if k != "m"]
    vast = lambda i: F.col("bits").bitwiseAND(1 << (10 + i)) != 0
    contexts = lambda where: F.explode(F.array(*(F.when(where(i), F.col(f"c_{k}")) for i, k in kinds))).alias("key")
    rows = people.select(*own, "bits", contexts(lambda i: ~vast(i))).where("key is not null")
    blocks = lambda df: df.repartition("key").sortWithinPartitions("key").mapInArrow(_comparer(pairs_of, across, differ), OUT)
    codes = area.table(blocks(rows), "codes")
    if large is None:
        return codes
    empty = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in SPREAD_ROW.split(", ")[-3:])]
    rows = held.select(*own, "bits", contexts(vast), *empty).where("key is not null")
    if across:  # contexts that one source alone holds make no pairs
        rows = rows.join(large.where("both").select(F.col("context").alias("key")), "key", "left_semi").select([x.split()[0] for x in SPREAD_ROW.split(", ")])
    apart = F.lit(SPREAD).cast("long")
    rows = area.table(spread(rows).withColumn("key", F.shiftleft(F.xxhash64("key", "sub"), 3).bitwiseOR(apart)), "spread")
    hot = broadcast_small(area.table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > gather), "hot"))
    chunks = F.ceil(F.col("many") * 2 / gather).cast("int")
    rows = rows.join(hot, "key", "left").withColumn("chunk", F.when(F.col("many").isNotNull(), F.pmod(F.xxhash64("record_id"), chunks).cast("int")))
    meets = F.when(F.col("many").isNotNull(), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.lit(None).cast("int")))
    pair = F.shiftleft(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")), 3).bitwiseOR(apart)
    rows = rows.withColumn("other", F.explode(meets)).withColumn("key", F.when(F.col("other").isNotNull(), pair).otherwise(F.col("key")))
    met = blocks(rows.select([x.split()[0] for x in SPREAD_ROW.split(", ")])).where("id1 is not null").distinct()
    return codes.unionByName(area.table(met, "codes"))
