"""Same postal address written differently.

A line is taken apart into house number with letter, unit, street and, where it stands in the line, town and postcode.
Number, letter and unit must agree exactly: they are vetoes, never evidence.  Spellings of street names are brought
together by a deletion-neighbourhood index of their words inside locality blocks: two spellings of one postcode, or of one
town where a record has no postcode, meet when a word of the one and a word of the other share a text with one or, in
longer words, two letters left out of each, and a rare spelling is taken for a misspelling of a common one when an optimal
assignment of their words, in any order, leaves few edits.
Spellings of towns are brought together in the same way, so that a record without postcode finds the block of its street.
The index holds distinct spellings, not records: a street or an address that very many records share costs no more.
Records of one block, street, number, letter and unit whose kinds of street do not contradict each other are one
location.

Edge cases: records without a usable line, or whose line has no number or no street, take no part; repeated rows count
once; a record without town and postcode, also in its line, is in no known place and takes no part; a missing kind of street agrees with any;
missing letters and units differ from given ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.clean import STAND_INS, usable
from tidemark.session import broadcast_small, scratch

#: Words for kinds of street and how they are shortened.
KINDS = {
    "avenue": "av ave aven avn", "street": "st str", "rise": "ris rse", "drive": "dr drv", "close": "cl clo", "lane": "la ln", "walk": "wk wlk", "gardens": "gdn gdns garden gds",
    "terrace": "ter terr", "road": "rd", "crescent": "cr cres cresc crs", "place": "pl plc", "circle": "cir circ", "boulevard": "blvd bvd boul", "trail": "tr trl", "court": "ct crt",
    "parkway": "pkwy pky pwy", "highway": "hwy hiway", "way": "wy", "square": "sq", "grove": "grv gr", "travesia": "trav trva tr tra", "camino": "cno cmno cam", "calle": "c cl call", "ronda": "rda rnda",
    "avenida": "av avd avda ave", "plaza": "pza plza pl", "paseo": "po pso",
}
#: Endings of one-word streets and how they are shortened.
ENDINGS = {
    "strasse": ("strasse", "strase", "str"), "weg": ("weg", "wg"), "gasse": ("gasse", "gass", "gs"), "allee": ("allee", "alle"), "platz": ("platz", "plz", "pl", "plt"),
    "straat": ("straat", "strt", "str"), "laan": ("laan", "ln"), "plein": ("plein", "pln", "pl"), "gracht": ("gracht", "gr", "grt"), "singel": ("singel",), "dijk": ("dijk",),
}
_ENDING_WORDS = {w for ws in ENDINGS.values() for w in ws}
_UNIT = r"(?:flat|flt|fl|apartments?|apartamento|apart|apt|appartement|app|unit|suite|ste|wohnung|whg|wng|piso|puerta|pta|bus|kamer|room|rm|door|dpto)"
_NUMBER_WORD = r"(?:nummer|numero|number|num|nro|nr|no|n[o°])"
_UK = re.compile(r"\b([a-z]{1,2}\d{1,2}[a-z]?)\s*(\d[a-z]{2})\b")
_NL = re.compile(r",?\s+(?:nl-?)?(\d{4})\s*([a-z]{2})\s*$")
_FIVE = re.compile(r"[\s,]+(\d{5})(?:-\d{4})?\s*$")
_UNIT_AT = re.compile(rf"(?:\b{_UNIT}\b\.?|#)\s*(?:{_NUMBER_WORD}\b\.?\s*)?(\d+\s?[a-z]?)\b")
_BEFORE_NUMBER = re.compile(rf"\b{_NUMBER_WORD}\b\.?\s*(?=\d)|#(?=\d)")
_HOUSE = re.compile(r"(?<![\w])(\d+)(?:[\s-]?([a-z])(?![a-z]))?")
_DOTTED = re.compile(r"(?<=[a-z]{3})(w|g|al|all)\.")
_DOTTED_FULL = {"w": "weg", "g": "gasse", "al": "allee", "all": "allee"}
_LETTERS = re.compile(r"[a-z]+")
_NO_VALUE = frozenset(STAND_INS)
#: Points of the compass, and words that towns are written together with.
COMPASS = {"n": "north", "s": "south", "e": "east", "w": "west", "north": "north", "south": "south", "east": "east", "west": "west"}
TOWN_PREFIX = re.compile(r"^(ober|unter|nieder|gross|klein|neu|alt|nieuw|oud)(?=[a-z]{5})")


def fold(text: str | None) -> str:
    if text and text.isascii():
        return " ".join(text.lower().split())
    text = unicodedata.normalize("NFKD", (text or "").replace("º", "o").replace("ª", "a").casefold().replace("ß", "ss"))
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


def apart(a: str, b: str) -> tuple[str, str]:
    """What is left of two words without their common beginning and end; it has as many edits as they have."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return a[i : len(a) - j], b[i : len(b) - j]


@lru_cache(50_000)
def near(a: str, b: str) -> float:
    """Likeness of two words, 1 for equal ones: one minus the share of Damerau-Levenshtein edits."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m or abs(n - m) > 3 or len(set(a) ^ set(b)) > 8:
        return 0.0
    longest = max(n, m)
    a, b = apart(a, b)
    n, m = len(a), len(b)
    before, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        last, before, row = before, row, [i] + [0] * m
        for j in range(1, m + 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], last[j - 2] + 1)
    return 1 - row[m] / longest


def edits(a: str, b: str) -> int:
    return round((1 - near(a, b)) * max(len(a), len(b), 1))


@lru_cache(20_000)
def town_key(text: str | None) -> str:
    """A town without blanks; of a word before its name, which is often written short, only the first letter."""
    text = fold(text)
    words = _LETTERS.findall(text) if text not in _NO_VALUE else []
    if len(words) == 1:
        return TOWN_PREFIX.sub(lambda m: m[1][0], words[0])
    return words[0][0] + "".join(words[1:]) if words else ""


@lru_cache(20_000)
def zip_key(text: str | None) -> str:
    """A postcode without blanks, country prefix, extension and with its leading nought."""
    text = fold(text)
    z = re.sub(r"^(?:nl|de?|es?|us)-", "", re.sub(r"[^a-z0-9-]", "", text)) if text not in _NO_VALUE else ""
    if re.fullmatch(r"\d{5}-?\d{4}", z):
        z = z[:5]
    z = z.replace("-", "")
    return "0" + z if re.fullmatch(r"\d{4}", z) else z


@lru_cache(20_000)
def kinds_of(word: str) -> frozenset[str]:
    """The kinds of street that a word may stand for."""
    return frozenset(k for k, short in KINDS.items() if word == k or word in short.split()) | frozenset(k for k, ws in ENDINGS.items() if word in ws)


@lru_cache(20_000)
def split_ending(word: str) -> tuple[str, frozenset[str]]:
    """Stem and kinds of a one-word street."""
    for size in range(min(7, len(word) - 3), 0, -1):
        if kinds := frozenset(k for k, ws in ENDINGS.items() if word[-size:] in ws):
            return word[:-size], kinds
    for size in (7, 6, 8, 5, 4, 3):  # a misspelt ending
        if len(word) - size >= 3:
            if kinds := frozenset(k for k in ENDINGS if len(k) >= 5 and edits(word[-size:], k) == 1):
                return word[:-size], kinds
    return word, frozenset()


@lru_cache(20_000)
def _street(words: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...], str]:
    """Names, kinds and compass of the words of a street."""
    compass, kinds, names = "", frozenset(), []
    for i, w in enumerate(words):
        if w in COMPASS and len(words) > 1 and not (len(w) > 1 and i == len(words) - 1):
            compass = COMPASS[w]
        elif (own := kinds_of(w)) and len(words) > 1 and not kinds:
            kinds = own
        elif w in ("de", "del", "la", "el", "los", "las", "der", "den", "van"):
            continue
        elif w in _ENDING_WORDS and names and not kinds:
            kinds = frozenset(k for k, ws in ENDINGS.items() if w in ws)
        else:
            names.append(w)
    if not kinds and len(names) > 1:  # a misspelt kind
        for w in (names[-1], names[0]):
            if len(w) >= 4 and (own := frozenset(k for k in KINDS if len(k) >= 4 and edits(w, k) <= (1 if len(k) < 7 else 2))):
                kinds = own
                names.remove(w)
                break
    if not kinds and len(names) == 1:
        stem, own = split_ending(names[0])
        if own:
            names, kinds = [stem], own
    return tuple(names or words[:1]), tuple(sorted(kinds)) if names else (), compass


def _taken(s: str, z: str) -> tuple[str, str, str, str, tuple[tuple[str, ...], ...]] | None:
    """Number, letter, unit, postcode and parts of words of a folded line; None without number or words."""
    if m := _UK.search(s):
        z, s = z or m[1] + m[2], s[: m.start()] + " , " + s[m.end() :]
    elif s[-1].isalpha() and (m := _NL.search(s)) and re.search(r"\d", s[: m.start()]) and len(re.findall(r"\d+", s)) > 1:
        z, s = z or m[1] + m[2], s[: m.start()]
    elif (m := _FIVE.search(s)) and re.search(r"\d", s[: m.start()]):
        z, s = z or m[1], s[: m.start()]
    unit = ""
    if m := _UNIT_AT.search(s):
        unit = re.match(r"\d+", m[1])[0]
        rest = m[1][len(unit) :].strip()
        if rest and m[1][len(unit)] != " ":
            unit += rest
            rest = ""
        s = f"{s[: m.start()]} , {rest} {s[m.end() :]}"
    s = _BEFORE_NUMBER.sub(" ", s)
    m = _HOUSE.search(s)
    if not m:
        return None
    letter, end = m[2] or "", m.end()
    if letter and re.search(r"\d\s", m[0]):  # apart from the number: a letter of the house, a point of the compass or, before a Spanish name, a kind
        if letter in "nsew" or (letter == "c" and re.match(r"[./]|\s+[a-z]", s[end:]) and not _street_follows(s[end:]) and (s[end : end + 1] in "./" or z[:1].isdigit())):
            letter, end = "", m.end(1)
    number = m[1].lstrip("0") or "0"
    s = s[: m.start()] + " , " + s[end:]
    if "." in s:
        s = _DOTTED.sub(lambda x: _DOTTED_FULL[x[1]], s)
    parts = tuple(tuple(p) for p in (_LETTERS.findall(x) for x in s.split(",")) if p)
    return (number, letter, unit, z, parts) if parts else None


@lru_cache(50_000)
def _around(before: str, after: str, digits: bool) -> tuple | None:
    """What ``_taken`` takes from a line with a number between these texts, whatever its digits are: a number that stands by
    itself is neither a postcode nor part of one where it is the only one. () if there are other digits in the texts."""
    return () if _DIGIT.search(before) or _DIGIT.search(after) else _taken(f"{before}1{after}", "0" if digits else "")


@lru_cache(20_000)
def _tails(words: tuple[str, ...]) -> tuple[tuple[int, str], ...]:
    """(words, key) of the ends of a line that may be the town without a comma before it."""
    return tuple((k, town_key(" ".join(words[-k:]))) for k in (1, 2, 3) if len(words) > k) if len(words) > 1 and not kinds_of(words[-1]) else ()


@lru_cache(20_000)
def _street_row(words: tuple[str, ...]) -> tuple[str, str] | None:
    """Street and kinds of the words of a street as texts."""
    names, kinds, _ = _street(words)
    return (" ".join(sorted(names)), ",".join(kinds)) if names else None


def _street_follows(rest: str) -> bool:
    """Whether the words after a number and a letter hold a kind of street, so that the letter is the number's."""
    words = [w for w in re.findall(r"[a-z]+", rest.split(",")[0]) if w not in COMPASS]
    return (len(words) > 1 and bool(kinds_of(words[-1]) or kinds_of(words[0]))) or (len(words) == 1 and bool(split_ending(words[0])[1]))


def assigned_edits(a: str, b: str) -> int:
    """Edits that the best assignment of the words of two names leaves, in any order; spare words count whole."""
    x, y = sorted((a.split(), b.split()), key=len)
    if len(x) == len(y) == 1:
        return edits(a, b)
    if len(y) > 5:
        return edits("".join(sorted(x)), "".join(sorted(y)))
    best = min((sum(edits(p, q) for p, q in zip(x, order)), sum(map(len, order))) for order in permutations(y, len(x)))
    return best[0] + sum(map(len, y)) - best[1]


@lru_cache(50_000)
def leave_out(word: str) -> tuple[str, ...]:
    """The word and what is left of it without one letter, of words of DEEP letters and more also without two."""
    one = [word[:i] + word[i + 1 :] for i in range(len(word))] if len(word) > 3 else []
    two = [x[:i] + x[i + 1 :] for j, x in enumerate(one) for i in range(j, len(x))] if len(word) >= DEEP else []
    return tuple(dict.fromkeys([word, *one, *two]))


def name_keys(name: str) -> list[str]:
    """The keys of a street in the index: those of each of its words, whatever their order."""
    return list(dict.fromkeys(k for w in name.split() for k in leave_out(w)))


#: Letters from which a word is indexed without two of them.
DEEP = 7
PARSED = ["number", "letter", "unit", "street", "kinds", "town", "zip"]
_NOTHING = (None,) * len(PARSED)
_NUMBER, _DIGIT = re.compile(r"(?<!\w)(\d+)(?!\w)"), re.compile(r"\d")


def parse_row(line: str | None, town: str | None, code: str | None) -> tuple[str | None, ...]:
    """The values of PARSED; nulls for a line without number and street."""
    s = fold(line)
    if not s or s in _NO_VALUE:
        return _NOTHING
    z, t = zip_key(code), town_key(town)
    text = _NUMBER.split(s)
    taken = _around(text[0], text[2], z[:1].isdigit()) if len(text) == 3 else ()
    if taken == ():
        taken = _taken(s, z)
    elif taken:
        taken = (text[1].lstrip("0") or "0", taken[1], "", z, taken[4])
    if not taken:
        return _NOTHING
    number, letter, unit, z, parts = taken
    # a part that is the town, or stands after the street
    if len(parts) > 1:
        keep = []
        for p in parts:
            name = town_key(" ".join(p))
            if t and len(name) > 4 and near(name, t) >= 0.75:
                continue
            keep.append(p)
        if not t and len(keep) > 1:
            t = town_key(" ".join(keep.pop()))
        parts = keep or parts
    words = parts[0] if len(parts) == 1 else tuple(w for p in parts for w in p)
    if t:
        for k, tail in _tails(words):
            if near(tail, t) >= 0.8:
                words = words[:-k]
                break
    street = _street_row(words)
    return (number, letter, unit, *street, t, z) if street else _NOTHING


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = [parse_row(*x) for x in zip(df["line"], df["town"], df["zip"])]
        yield pd.concat([df[["record_id"]], pd.DataFrame(rows, columns=PARSED, index=df.index)], axis=1)


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        df["key"] = df["name"].map(name_keys)
        yield df.explode("key")


def _misspelt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps (name, other) where ``name`` is likely a misspelling of ``other``: near to it and much rarer in all data."""
    for df in batches:
        e = [assigned_edits(a, b) for a, b in zip(df["name"], df["other"])]
        n, m = df["all_n"].to_numpy(), df["other_all_n"].to_numpy()
        e, size = pd.Series(e, index=df.index), df["name"].str.len()
        one = (e <= 1) & ((n < 10) | (n < 0.3 * m))
        two = (e == 2) & (size >= 5) & ((n <= 2) | (n < 0.1 * m))
        yield df[one | two].assign(e=e[one | two])[["block", "name", "other", "e", "other_n", "other_all_n"]]


def canonical_names(spellings: DataFrame, area) -> DataFrame:
    """spellings(block, name, n) -> (block, name, canon) of the names of a block that are taken for another spelling.

    A name leads to a commoner one that it likely misspells (fewest edits, then the commonest); two steps are followed.
    """
    counts = spellings.groupBy("name").agg(F.sum("n").alias("all_n"))
    known = area.table(spellings.join(counts, "name"), "spellings")
    keyed = area.table(known.select("block", "name", "n", "all_n").mapInPandas(_variants, "block string, name string, n long, all_n long, key string"), "keys")
    other = keyed.select("block", "key", F.col("name").alias("other"), F.col("n").alias("other_n"), F.col("all_n").alias("other_all_n"))
    commoner = F.struct("other_all_n", "other_n", "other") > F.struct("all_n", "n", "name")
    met = keyed.join(other, ["block", "key"]).where((F.col("name") != F.col("other")) & commoner).drop("key").distinct()
    likely = met.mapInPandas(_misspelt, "block string, name string, other string, e long, other_n long, other_all_n long")
    best = area.table(likely.groupBy("block", "name").agg(F.min_by("other", F.struct("e", -F.col("other_n"), -F.col("other_all_n"), "other")).alias("canon")), "canon")
    onward = best.select("block", F.col("name").alias("canon"), F.col("canon").alias("further"))
    best = best.join(onward, ["block", "canon"], "left").select("block", "name", F.coalesce("further", "canon").alias("canon"))
    return area.table(best, "canon")


def resolve(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """parsed(*keep, street, town, zip), a written table, with the block and the canonical street of every row that has a
    street.

    Returns keep, block and street; rows without a street have nulls there.  All spellings are brought together on the
    counted distinct streets of towns and postcodes; the rows themselves only look their misspelt values up.
    """
    area = scratch(parsed.sparkSession)
    count = F.sum("n").alias("n")
    there = area.table(parsed.where("street is not null").groupBy("zip", "town", "street").agg(F.count(F.lit(1)).alias("n")), "streets")
    towns = canonical_names(there.where("town <> ''").groupBy(F.lit("").alias("block"), F.col("town").alias("name")).agg(count), area)
    towns = broadcast_small(towns.select(F.col("name").alias("town"), F.col("canon").alias("true_town")))
    streets = canonical_names(there.where("zip <> ''").groupBy(F.col("zip").alias("block"), F.col("street").alias("name")).agg(count), area)
    streets = broadcast_small(streets.select(F.col("block").alias("zip"), F.col("name").alias("street"), F.col("canon").alias("true_street")))
    place = F.nullif(F.coalesce("true_town", "town"), F.lit("")).alias("place")
    known = there.join(streets, ["zip", "street"], "left").join(towns, "town", "left").select("zip", place, F.coalesce("true_street", "street").alias("street"), "n")

    # rows without postcode: the block of the street of that name in their town
    where = known.where("zip <> '' and place is not null").groupBy("place", "street", "zip").agg(count)
    where = where.groupBy(F.col("place").alias("block"), F.col("street").alias("name")).agg(F.max_by("zip", F.struct("n", "zip")).alias("zip"), F.sum("n").alias("n"))
    asked = known.where("zip = ''").select(F.coalesce("place", F.lit("?")).alias("block"), F.col("street").alias("name")).distinct()
    wanted = broadcast_small(area.table(asked.select("block").distinct(), "places"))
    keyed = where.join(wanted, "block", "left_semi").mapInPandas(_variants, "block string, name string, zip string, n long, key string").select("block", "key", F.col("name").alias("other"), "zip", "n")
    asked = asked.mapInPandas(_variants, "block string, name string, key string")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            e = pd.Series([assigned_edits(a, b) for a, b in zip(df["name"], df["other"])], index=df.index, dtype="int64")
            ok = e <= (df["name"].str.len() >= 5).map({True: 2, False: 1}).astype("int64")
            yield df[ok].assign(e=e[ok])[["block", "name", "other", "zip", "n", "e"]]

    found = asked.join(keyed, ["block", "key"]).drop("key").distinct().select("block", "name", "other", "zip", "n").mapInPandas(close, "block string, name string, other string, zip string, n long, e long")
    found = found.groupBy("block", "name").agg(F.min_by(F.struct("zip", "other"), F.struct("e", -F.col("n"), "other")).alias("f"))
    found = broadcast_small(area.table(found.select(F.col("block").alias("place"), F.col("name").alias("street"), "f", F.lit("").alias("zip")), "found"))
    rows = parsed.join(streets, ["zip", "street"], "left").join(towns, "town", "left").select(*keep, "zip", F.coalesce(place, F.lit("?")).alias("place"), F.coalesce("true_street", "street").alias("street"))
    out = rows.join(found, ["place", "street", "zip"], "left")
    block = F.when(F.col("zip") != "", F.col("zip")).otherwise(F.coalesce("f.zip", F.when(F.col("place") != "?", F.concat(F.lit("t:"), "place"))))
    return out.select(*keep, F.when(F.col("street").isNotNull(), block).alias("block"), F.coalesce("f.other", "street").alias("street"))


def locate(records: DataFrame) -> DataFrame:
    """records(record_id, line, town, zip) -> (record_id, number, letter, unit, kinds, block, street) of usable lines."""
    area = scratch(records.sparkSession)
    rows = records.where(usable(F.col("line"))).select("record_id", "line", "town", "zip")
    parsed = area.table(rows.mapInPandas(_parsed, "record_id string, " + ", ".join(f"{c} string" for c in PARSED)), "parsed")
    return resolve(parsed, ["record_id", "number", "letter", "unit", "kinds"]).where("block is not null")


def same_location(records: DataFrame) -> DataFrame:
    """(record_id_1, record_id_2) of all records of one location."""
    here = scratch(records.sparkSession).table(locate(records), "located")
    key = ["block", "street", "number", "letter", "unit"]
    x = here.select(*key, F.col("record_id").alias("record_id_1"), F.col("kinds").alias("k1"))
    y = here.select(*key, F.col("record_id").alias("record_id_2"), F.col("kinds").alias("k2"))
    agree = (F.col("k1") == "") | (F.col("k2") == "") | F.arrays_overlap(F.split("k1", ","), F.split("k2", ","))
    return x.join(y, key).where((F.col("record_id_1") < F.col("record_id_2")) & agree).select("record_id_1", "record_id_2").distinct()
