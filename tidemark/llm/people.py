"""Persons and firms: cleaned attributes of records, how two records compare, and how sure a comparison makes us.

The parts that linking names (``names``) and matching entities (``matching``) share: profiles of records, pairwise
features, and a logistic model of them.  The model is trained on weak labels, pairs that an earlier process joined.
These are a sample of the true pairs, so the fit is that of positive and unlabelled data: what the classifier says is
divided by the labelled share, taken from pairs beyond doubt, which calibrates it to probabilities.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.address import edits, parse_row, resolve
from tidemark.session import broadcast_small, scratch

#: The lexicon holds words that fill at least one in so many places of all names, so no more words than that.
LEXICON_PLACES = 250_000
#: A contact value or place that more records hold is busy: it says less than others, how much is learnt; no record is left out for it.
MAX_HOLDERS = 60
#: So many days people are born on; a date held by COMMON_DAY times its share of the records is a default, not a birthday.
DAYS, COMMON_DAY = 36_500, 40
#: So many contexts that are too large for one block are looked for by a list.
LISTED = 500
#: Titles, generations, legal forms, words of a firm's desk.
TITLES = frozenset("mr mrs ms miss dr prof sir dame herr frau sr sra srta dhr mevr mw jr snr jnr ii iii iv dipl ing".split())
LEGAL = frozenset("ltd limited plc gmbh bv sl llc inc co corp company kg ag nv sa incorporated".split())
DESK = frozenset("accounts office the and sons und y en".split())
#: Everyday short names whose first letters differ from the full one, or that are hard to see.
NICKNAMES = {
    "theodore": "ted teddy theo", "winifred": "freda win", "abigail": "gail abby", "eleanor": "nell ellie nora", "dorothy": "dot dottie", "harriet": "hattie", "henrietta": "hettie etta",
    "francisco": "pancho paco", "margaretha": "greet greta", "petronella": "nel", "hendrika": "rika", "mercedes": "merche", "antonius": "toon", "adriaan": "adje", "wilhelmine": "mina minna",
    "wilhelmus": "wim", "friederike": "rike", "katharina": "kathi", "guadalupe": "lupe", "encarnacion": "encarna", "veronica": "ronnie", "rosalind": "roz", "philippa": "pippa", "victoria": "tori vicky",
    "theodora": "dora", "manuel": "manolo", "ignacio": "nacho", "concepcion": "concha", "dolores": "lola", "rosario": "charo", "edmund": "ned", "reginald": "reg reggie rex", "bartholomew": "bart",
    "archibald": "archie", "lucille": "lucy lou", "augustus": "gus", "sebastian": "basti seb", "cynthia": "cindy", "richard": "dick", "william": "bill will", "robert": "bob rob", "margaret": "peggy meg",
    "elizabeth": "betty liz beth", "jeremiah": "jerry", "gerrit": "ger", "jacobus": "koos jaap", "johannes": "hans jan hannes", "cornelis": "kees", "maximilian": "max", "hannelore": "hanne lore",
    "savannah": "vannah savvy", "bethany": "beth", "josephine": "jo josie", "cassandra": "cass sandra", "tabitha": "tabby", "penelope": "penny nell", "vincent": "vince vinny", "asuncion": "asun", "teofilo": "teo",
    "primitivo": "primi", "leendert": "leen", "berendina": "dina", "brunhilde": "bruni", "kunigunde": "gunda", "mechthild": "mecki", "waltraud": "traudel", "sieglinde": "sigi linde", "hazel": "haze",
    "gabriel": "gabe", "leonard": "len lenny leo", "nicholas": "nick nicky", "hendrik": "henk", "zachary": "zack zac", "nathaniel": "nate nat", "alexander": "sandy lex", "catherine": "kitty", "michael": "mick mike",
}
_SHORT = {(full, s) for full, shorts in NICKNAMES.items() for s in shorts.split()}
_SHORTS = {full: set(shorts.split()) for full, shorts in NICKNAMES.items()}
#: short form -> the full names it may stand for
_FULL: dict[str, list[str]] = {}
for _full, _shorts in _SHORTS.items():
    for _s in _shorts:
        _FULL.setdefault(_s, []).append(_full)
_SHORT |= {(b, a) for a, b in _SHORT}
SHORT_FORMS = frozenset(_FULL)
NICKNAMED = SHORT_FORMS | frozenset(NICKNAMES)
_UMLAUT = re.compile("(?<=[aou])e")
_DOTTED = re.compile(r"\b([a-z])\.\s?([a-z])\.(?=\W|$)")
_WORDS = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")


def fold(text: str | None) -> str:
    if text and text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", (text or "").casefold())
    return "".join(c for c in text if not unicodedata.combining(c))


def name_words(name: str | None) -> list[str]:
    """The words of a name, folded; dotted legal forms and initials written together apart."""
    text = fold(name)
    if text.isascii() and text.replace(" ", "").isalpha():
        return text.split()
    return _WORDS.findall(_DOTTED.sub(r"\1\2", text) if "." in text else text)


_NEITHER = (0.5, 0)  # a word that the lexicon doesn't hold
COUNTED_WORDS = "word string, f long, l long, c long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, last, firm = [], [], []
        for name in texts(batch.column("name")):
            words = name_words(name)
            if not TITLES.isdisjoint(words):
                words = [w for w in words if w not in TITLES]
            if not LEGAL.isdisjoint(words):
                firm += [w for w in words if w not in LEGAL and w not in DESK]
                continue
            if len(words) > 1 and min(map(len, words)) < 2:
                words = [w for w in words if len(w) > 1]
            if len(words) > 1:
                reverse = "," in name
                first.append(words[-1 if reverse else 0])
                last.append(words[0 if reverse else -1])
        first, last, firm = Counter(first), Counter(last), Counter(firm)
        words = list(first.keys() | last.keys() | firm.keys())
        yield arrow({"word": words, **{n: [c[w] for w in words] for n, c in (("f", first), ("l", last), ("c", firm))}}, COUNTED_WORDS)


def lexicon(records: DataFrame) -> dict[str, tuple[float, float]]:
    """word -> (share of places where it stands as a given name, share of places in firms' names), of words that stand in
    at least three places and one in LEXICON_PLACES; names of rarer words are split by place alone."""
    counts = records.select("name").mapInArrow(_count_words, COUNTED_WORDS).groupBy("word").agg(F.sum("f").alias("f"), F.sum("l").alias("l"), F.sum("c").alias("c"))
    total = F.col("f") + F.col("l") + F.col("c")
    counts = scratch(records.sparkSession).table(counts.withColumn("places", total), "words")
    places = counts.agg(F.sum("places")).first()[0] or 0
    rows = counts.where(F.col("places") >= max(3, -(-places // LEXICON_PLACES))).collect()  # at most LEXICON_PLACES rows
    return {r["word"]: ((r["f"] + 0.5) / (r["f"] + r["l"] + 1.0), r["c"] / (r["f"] + r["l"] + r["c"])) for r in rows}


def trade_words(words_of: dict[str, tuple[float, float]]) -> frozenset[str]:
    """The words of a lexicon that mostly stand in firms' names."""
    return frozenset(w for w, (_, share) in words_of.items() if share > 0.6)


def split_name(name: str | None, words_of: dict[str, tuple[float, float]], trades: frozenset[str] | None = None) -> tuple[bool, str, str, str]:
    """(firm, given, initial, rest): a person's given name and surnames, or a firm's words without its legal form.

    ``trades`` are the ``trade_words`` of the lexicon, where many names are split.
    """
    trades = trade_words(words_of) if trades is None else trades
    words = name_words(name)
    if not TITLES.isdisjoint(words):
        words = [w for w in words if w not in TITLES]
    firm = not LEGAL.isdisjoint(words) or bool(words) and words[0] in ("accounts", "office")
    if firm or not trades.isdisjoint(words):
        core = [w for w in words if w not in LEGAL and w not in DESK and len(w) > 1]
        if firm or (len(core) > 1 and sum(w in trades for w in core) * 2 >= len(core)):
            return True, "", "", " ".join(core or words).replace("-", " ")
    long, short = words, []
    if not words or min(map(len, words)) < 2:
        long, short = [w for w in words if len(w) > 1], [w for w in words if len(w) == 1]
    if not long:
        return False, "", short[0] if short else "", ""
    if len(long) == 1:
        if short or words_of.get(long[0], _NEITHER)[0] < 0.9:
            return False, "", short[0] if short else "", long[0].replace("-", " ")
        return False, long[0], long[0][0], ""
    order = long[1:] + long[:1] if "," in (name or "") else long
    # the first word unless the lexicon knows better
    at, best = 0, -9.0
    for i, w in enumerate(order):
        g = words_of.get(w, _NEITHER)[0]
        if (rank := (g > 0.5) * 2 + (i == 0) * 1.5 + g * 0.4 - 4 * ("-" in w)) > best:
            at, best = i, rank
    return False, order[at], order[at][0], " ".join(order[:at] + order[at + 1 :]).replace("-", " ")


@lru_cache(100_000)
def letters(word: str) -> int:
    """The letters of a word as bits."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 61
    return bits


def typed_alike(a: str, b: str, k: int) -> bool:
    """Whether two words are within k typing errors; lengths and letters rule most pairs out at once."""
    if abs(len(a) - len(b)) > k or (letters(a) ^ letters(b)).bit_count() > 2 * k:
        return False
    return edits(a, b) <= k


def alike(a: str, b: str) -> str:
    """E equal, T within the typing errors of the length, N a short form of the other, D different."""
    if a == b:
        return "E"
    # other first letters and many letters that only one has: neither typing errors nor a short form, but for listed ones
    if a[:1] != b[:1] and (letters(a) ^ letters(b)).bit_count() > 5 and a not in _FULL and b not in _FULL:
        return "D"
    return _alike(a, b)


@lru_cache(100_000)
def _alike(a: str, b: str) -> str:
    n = min(len(a), len(b))
    if n >= 3 and typed_alike(a, b, 1 if n < 6 else 2):
        return "T"
    if (n >= 3 and (a.startswith(b) or b.startswith(a))) or (a, b) in _SHORT:
        return "N"
    for short, other in ((a, b), (b, a)):
        for full in _FULL.get(short, ()):
            if other in _SHORTS[full] or (len(other) >= 5 and typed_alike(other, full, 2)):
                return "N"
    if _UMLAUT.search(a) or _UMLAUT.search(b):  # an umlaut written with e
        x, y = _UMLAUT.sub("", a), _UMLAUT.sub("", b)
        if (x, y) != (a, b) and (x == y or typed_alike(x, y, 1 if n < 6 else 2)):
            return "T"
    x, y = (a, b) if len(a) < len(b) else (b, a)
    if len(x) >= 4 and x[-2:] in ("ie", "my", "ny", "ey") or x.endswith("y"):
        stem = x.rstrip("iey")
        if len(stem) >= 3 and (y.startswith(stem) or (len(stem) > 3 and stem[-1] == stem[-2] and y.startswith(stem[:-1]))):
            return "N"
    return "D"


@lru_cache(50_000)
def given_like(g1: str, i1: str, g2: str, i2: str) -> str:
    """E, T, N as in ``alike``; I initials agree; M missing; D different."""
    if g1 and g2:
        return alike(g1, g2)
    if not i1 or not i2:
        return "M"
    full = g1 or g2
    other = i2 if g1 else i1
    if i1 == i2 or (full and any(s[0] == other for f, s in _SHORT if f == full)):
        return "I"
    return "D"


@lru_cache(50_000)
def surname_like(s1: str, s2: str) -> str:
    """E, T as in ``alike``; C one of several surnames is shared; M missing; D different."""
    if not s1 or not s2:
        return "M"
    if s1 == s2:
        return "E"
    x, y = s1.split(), s2.split()
    if len(x) == len(y) == 1:
        return {"N": "D"}.get(k := alike(s1, s2), k)
    return "C" if any(alike(p, q) in "ET" for p in x for q in y) else "D"


def firm_like(s1: str, s2: str) -> str:
    """E the same words, T the same but for typing errors and short forms, C most words, D different."""
    x, y = s1.split(), s2.split()
    if sorted(x) == sorted(y):
        return "E"
    small, large = sorted((x, y), key=len)
    rest, met = list(large), 0
    for w in small:
        if hit := next((v for v in rest if alike(w, v) in "ETN" or (len(w) > 2 and w[0] == v[0] and set(w) <= set(v))), None):
            rest.remove(hit)
            met += 1
    if met == len(small) == len(large):
        return "T"
    return "C" if met and met >= 0.6 * len(large) else "D"


def given_from_mail(local: str | None, initial: str, rest: str, words_of: dict[str, tuple[float, float]]) -> str:
    """A given name that an e-mail address spells out where the name has its initial only, or nothing but a surname that
    the address holds too."""
    if not local:
        return ""
    words = re.findall(r"[a-z]{3,}", local)
    for w in words:
        if w != rest and words_of.get(w, (0, 0))[0] > 0.7 and (w[0] == initial if initial else any(x in words for x in rest.split())):
            return w
    return ""


def _raw(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sources in one shape."""
    blank = lambda c: F.expr(f"nullif({c}, '')")
    left = a.select(F.col("cust_id").alias("record_id"), F.lit(True).alias("a"), F.col("full_name").alias("name"), "email", "phone", F.col("date_of_birth").cast("string").alias("born"), F.col("addr_line").alias("line"), F.col("city").alias("town"), F.col("postcode").alias("zip"))
    right = b.select(F.col("client_ref").alias("record_id"), F.lit(False).alias("a"), F.concat_ws(" ", blank("first_name"), blank("last_name")).alias("name"), F.col("email_addr").alias("email"), F.col("mobile").alias("phone"), F.col("dob").alias("born"), F.col("street").alias("line"), "town", "zip")
    return left.unionByName(right).where("record_id is not null").withColumn("name", F.coalesce("name", F.lit("")))


_MAIL = re.compile(r"[^@\s]+@[^@\s]+\.[a-z]+")
_NOBODY = re.compile(r"(?:none|unknown|no|x)@")
_NO_DIGIT = bytes(x for x in range(256) if not 48 <= x < 58)
_EXTENSION = re.compile(r"\s*(?:ext|x|extension)\.?\s*\d*\s*$")
_DMY, _YMD = re.compile(r"\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\s*"), re.compile(r"\s*(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})\s*")


def clean_mail(mail: str | None) -> str | None:
    """An e-mail address in lower case without blanks; None for what is none."""
    if not mail or "@" not in mail:
        return None
    mail = "".join(mail.lower().split()).removeprefix("mailto:")
    return mail if _MAIL.fullmatch(mail) and not _NOBODY.match(mail) else None


def clean_phone(phone: str | None) -> int | None:
    """The last ten digits of a number of seven or more without its extension; None for numbers of one digit."""
    if not phone:
        return None
    if "x" in phone or "X" in phone:
        phone = _EXTENSION.sub("", phone.lower())
    digits = phone.encode().translate(None, _NO_DIGIT)
    return int(digits[-10:]) if len(digits) >= 7 and digits.count(digits[:1]) < len(digits) else None


@lru_cache(100_000)
def clean_day(text: str | None) -> int | None:
    """A date typed day/month/year or year-month-day as yyyymmdd; None for days that don't exist or lie before 1911."""
    if not text:
        return None
    if m := _DMY.fullmatch(text):
        d, mo, y = int(m[1]), int(m[2]), int(m[3])
    elif m := _YMD.fullmatch(text):
        y, mo, d = int(m[1]), int(m[2]), int(m[3])
    else:
        return None
    if not (1910 < y < 2100 and 1 <= mo <= 12 and 1 <= d <= 31):
        return None
    last = 31 if mo in (1, 3, 5, 7, 8, 10, 12) else 30 if mo != 2 else 29 if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) else 28
    return y * 10000 + mo * 100 + d if d <= last else None


def _flip(dob: str) -> Column:
    """A date without regard to day and month exchanged."""
    day, month = F.col(dob) % 100, F.floor(F.col(dob) / 100) % 100
    return F.floor(F.col(dob) / 10000) * 10000 + F.least(day, month) * 100 + F.greatest(day, month)


#: Kinds of contexts in the order in which a pair of records is met: part before the @, whole address, phone, place, date.
KINDS = {"e": "local", "m": "email", "p": "phone", "l": "place", "d": "dob"}
NAME = "\x1f"
#: What a profile holds: firm or person, given name, initial and surnames or words as one text; values as 64-bit hashes.
PROFILE = "record_id string, a boolean, who string, nm long, local long, email long, phone long, dob int, place long, town int"


def context(kind: str) -> Column:
    """The context of a profile's value: the value's bits and the number of its kind; null where the value is missing."""
    value = F.when(F.col("email") != F.col("local"), F.col("email")) if kind == "m" else -_flip("dob") if kind == "d" else F.col(KINDS[kind])
    return F.shiftleft(value.cast("long"), 3).bitwiseOR(F.lit(list(KINDS).index(kind)).cast("long"))


def texts(column: pa.Array) -> list[str | None]:
    """The values of a column of texts, in a tenth of the time of to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


def arrow(columns: dict[str, list], shape: str) -> pa.RecordBatch:
    """A batch of lists, typed as a DDL string says."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = dict(x.split() for x in shape.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) for n, t in types.items()], names=list(types))


def profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """(*PROFILE), a written table: the cleaned attributes of every record, null where missing.

    Each record is parsed once, where it lies; rows delivered twice stay twice, pairs of records are made distinct.
    """
    spark = a.sparkSession
    area = scratch(spark)
    everyone = _raw(a, b)
    words_of = spark.sparkContext.broadcast(lexicon(everyone))
    shape = "record_id string, a boolean, who string, nm long, mail string, phone long, dob int, house string, street string, town string, zip string"
    names = [x.split()[0] for x in shape.split(", ")]
    taken = ("name", "email", "phone", "born", "line", "town", "zip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_of.value
        trades = trade_words(known)
        for batch in batches:
            # column by column: one kind of work at a time takes three quarters of the time of record by record
            names_, mails, phones, days, lines, towns, codes = (texts(batch.column(c)) for c in taken)
            mails = [clean_mail(x) for x in mails]
            who = []
            for (firm, given, initial, rest), mail in zip([split_name(x, known, trades) for x in names_], mails):
                if mail and not firm and not given and (spelt := given_from_mail(mail.partition("@")[0], initial, rest, known)):
                    given, initial = spelt, initial or spelt[0]
                who.append(NAME.join(("F" if firm else "P", given, initial, rest)))
            placed = [parse_row(*x) for x in zip(lines, towns, codes)]
            number, letter, unit, streets, _, towns, codes = zip(*placed) if placed else [()] * 7
            houses = [n and f"{n}|{k}|{u}" for n, k, u in zip(number, letter, unit)]
            out = (who, mails, [clean_phone(x) for x in phones], [clean_day(x) for x in days], houses, streets, towns, codes)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 4)
            cols = [pa.array(x, k) for x, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("a"), cols[0], batch.column("nm"), *cols[1:]], names=names)

    local = F.substring_index("mail", "@", 1)
    done = everyone.select("record_id", "a", F.xxhash64("name").alias("nm"), *taken).mapInArrow(run, shape).withColumns(
        {"email": F.when(F.col("mail").isNotNull(), F.xxhash64("mail")), "local": F.when(F.col("mail").isNotNull(), F.xxhash64(F.when(F.length(local) > 5, local).otherwise(F.col("mail"))))}
    )
    own = ["record_id", "a", "who", "nm", "local", "email", "phone", "dob"]
    parsed = area.table(done.select(*own, "house", "street", "town", "zip"), "parsed")
    placed = resolve(parsed, [*own, "house"])
    there = F.col("block").isNotNull()
    people = area.table(placed.select(*own, F.when(there, F.xxhash64("block", "street", "house")).alias("place"), F.when(there, F.hash("block")).alias("town")), "profiles")
    area.drop(parsed)
    return people


def marked(people: DataFrame, gather: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """people with ``bits`` and the contexts c_e, c_p, c_l and c_d of their values; those of them with a context that is too
    large for one block; and such contexts with whether both sources hold them (context, both). None if there are none.

    A value is busy where more distinct records hold it than its limit: bits 2k and 2k + 1 of kind k have 1 where few
    names hold it and 2 where many do.  Bit 10 + k is set where more than ``gather`` rows hold the context.  Busy values
    make contexts like any other, so all that hold one meet; whole e-mail addresses make none, as their parts before the
    @ do, but are judged by themselves where that part is busy.
    """
    area = scratch(people.sparkSession)
    each = F.explode(F.array(*(context(k) for k in "epld"))).alias("context")
    counts = people.select(each, "a").where("context is not null").groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("of_a"))
    crowded = area.table(counts.where(F.col("n") > min(MAX_HOLDERS, gather)), "crowded")
    born = people.agg(F.count("dob")).first()[0]
    is_day = F.col("context").bitwiseAND(F.lit(7).cast("long")) == list(KINDS).index("d")
    limit = F.when(is_day, F.lit(max(MAX_HOLDERS, COMMON_DAY * born // DAYS))).otherwise(F.lit(MAX_HOLDERS))

    def busy(rows: DataFrame) -> DataFrame:
        """(context, level) of the contexts that more distinct records than their limit hold."""
        held = rows.groupBy("context").agg(F.count_distinct("record_id").alias("n"), F.count_distinct("named").alias("names")).where(F.col("n") > limit)
        return held.select("context", F.when(F.col("names") <= MAX_HOLDERS, 1).otherwise(2).alias("level"))

    own = ["record_id", F.xxhash64("who").alias("named")]
    held = area.table(busy(people.select(*own, each).join(broadcast_small(crowded.where(F.col("n") > limit).select("context")), "context")), "busy")
    loud = broadcast_small(held.select(F.col("context").alias("c_e")))
    whole = busy(people.withColumn("c_e", context("e")).join(loud, "c_e").select(*own, context("m").alias("context")).where("context is not null"))
    vast = crowded.where(F.col("n") > gather).select("context", F.lit(1).alias("vast"))
    marks = broadcast_small(area.table(held.unionByName(whole).join(vast, "context", "full"), "marks"))
    bit = lambda c, at: F.shiftleft(F.coalesce(c, F.lit(0)), at)

    def mark(rows: DataFrame) -> DataFrame:
        for k in KINDS:
            rows = rows.join(marks.select(F.col("context").alias(f"c_{k}"), F.col("level").alias(f"v_{k}"), F.col("vast").alias(f"w_{k}")), f"c_{k}", "left")
        # a whole address counts by itself where its part before the @ is busy
        rows = rows.withColumn("v_m", F.when(F.col("email") == F.col("local"), F.col("v_e")).when(F.col("v_e").isNotNull(), F.col("v_m"))).drop("c_m")
        return rows.withColumn("bits", sum((bit(f"v_{k}", 2 * i) + bit(f"w_{k}", 10 + i) for i, k in enumerate(KINDS) if k != "m"), bit("v_m", 2)))

    large = area.table(crowded.where(F.col("n") > gather).select("context", ((F.col("of_a") > 0) & (F.col("of_a") < F.col("n"))).alias("both")), "vast")
    plain = people.withColumns({f"c_{k}": context(k) for k in KINDS})
    contexts = [r[0] for r in large.select("context").limit(LISTED + 1).collect()]
    if not contexts:
        return mark(plain), None, None
    # where they are few, the other rows aren't marked again
    held = plain.where(F.greatest(*(F.coalesce(F.col(f"c_{k}").isin(contexts), F.lit(False)) for k in "epld"))) if len(contexts) <= LISTED else plain
    return mark(plain), mark(held).where(F.col("bits") >= 1 << 10), broadcast_small(large)


@lru_cache(20_000)
def named(who: str) -> tuple[bool, str, str, str]:
    """(firm, given, initial, rest) of a profile."""
    firm, given, initial, rest = who.split(NAME)
    return firm == "F", given, initial, rest


def name_code(x: tuple[bool, str, str, str], y: tuple[bool, str, str, str]) -> str:
    """How given names and surnames or firms' words agree, and whether persons (P) or firms (F) are compared, or both (B)."""
    f1, g1, i1, s1 = x
    f2, g2, i2, s2 = y
    if f1 and f2:
        return "M" + firm_like(s1, s2) + "F"
    if f1 != f2:  # a firm whose legal form is missing, or a person's own firm
        s = firm_like(f"{g1} {s1}".strip(), f"{g2} {s2}".strip())
        return ("M" if s in "ET" else "D") + s + "B"
    g, s = given_like(g1, i1, g2, i2), surname_like(s1, s2)
    if (g in "DM" or s in "DM") and g1 and g2 and s1 and s2:  # given name and surname taken for each other
        g_, s_ = alike(g1, s2), alike(s1, g2)
        if g_ in "ETN" and s_ in "ETN":
            g, s = g_, "T" if s_ == "N" else s_
    return g + s + "P"


#: Prior weights, in log-odds, towards which the fit is drawn.
PRIOR = {
    "bias": -6.0, "eE": 7.0, "eL": 6.0, "eX": -1.0, "pE": 5.0, "pX": -1.2, "dE": 5.5, "dS": 4.5, "dT": 1.0, "dX": -6.0, "lE": 3.0, "lT": 0.0, "lX": -0.3,
    "gE": 2.5, "gT": 2.0, "gN": 2.0, "gI": 1.0, "gD": -6.0, "sE": 1.5, "sT": 1.2, "sC": 1.0, "sD": -3.0, "fB": -1.0, "fF": 1.0,
}
#: Log-odds by prior weights below which a pair is no candidate.
HOPELESS = -7.0
#: H equal on a busy value of few names, B on one of many: without prior weight, what they say is learnt.
CODES = {"e": "ELMXHB", "p": "EMXHB", "l": "EMTXHB", "d": "ESTMXHB", "g": "ETNIMD", "s": "ETCMD", "f": "PFB"}
CROSS = (("e", "d"), ("e", "p"), ("p", "d"), ("l", "d"), ("e", "g"), ("p", "g"), ("l", "g"), ("d", "g"), ("g", "s"), ("d", "s"), ("f", "s"), ("e", "l"), ("p", "l"))
FEATURES = ["bias", *(a + x for a in CODES for x in CODES[a]), *(a + x + b + y for a, b in CROSS for x in CODES[a] for y in CODES[b])]
_AT = {f: i for i, f in enumerate(FEATURES)}


def design(c: pd.DataFrame) -> np.ndarray:
    """Numbers of the features that are set in each row of codes; every row has equally many."""
    cols = [np.zeros(len(c), dtype=np.int64)]
    cols += [c[a].map({x: _AT[a + x] for x in CODES[a]}).to_numpy() for a in CODES]
    for a, b in CROSS:
        cols.append((c[a] + c[b]).map({x + y: _AT[a + x + b + y] for x in CODES[a] for y in CODES[b]}).to_numpy())
    return np.stack(cols, axis=1).astype(np.int64)


def fit(codes: pd.DataFrame, label: np.ndarray, weight: np.ndarray, ridge: float = 3.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of the features and the labelled share of the true pairs, from weighted positive and unlabelled pairs."""
    prior = np.array([PRIOR.get(f, 0.0) for f in FEATURES])
    x = design(codes)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    sure = (codes["e"].isin(["E", "L"]) & codes["p"].eq("E") & codes["d"].eq("E") & codes["g"].isin(["E", "T", "N"]) & codes["s"].isin(["E", "T"])).to_numpy()
    share = float(np.clip((weight[sure] @ label[sure] + 1) / (weight[sure].sum() + 7), 0.02, 0.98)) if sure.any() else 0.15
    w, rate, m, v = prior.copy(), 0.05, np.zeros(len(prior)), np.zeros(len(prior))
    for step in range(1, steps + 1):
        # a labelled pair is a true one that was seen: P(label) = share * P(true)
        p = sigmoid(w[x].sum(axis=1))
        q = np.clip(share * p, 1e-9, 1 - 1e-9)
        slope = weight * (label / q - (1 - label) / (1 - q)) * share * p * (1 - p)
        grad = np.bincount(x.ravel(), np.repeat(slope, x.shape[1]), minlength=len(w)) - ridge * (w - prior)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, share


def score(codes: pd.DataFrame, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[design(codes)].sum(axis=1), -30, 30)))


def joined_before(golden: DataFrame) -> DataFrame:
    """(first, second) of records that one golden row stems from: the weak labels."""
    refs = F.concat(F.array("source_a_ref", "source_b_ref"), F.split(F.coalesce("merged_a_refs", F.lit("")), ","))
    refs = F.array_sort(F.array_distinct(F.filter(F.transform(refs, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
    one = golden.select(refs.alias("refs")).where(F.size("refs") > 1).select("refs", F.posexplode("refs").alias("at", "first"))
    return one.select("first", F.explode(F.slice("refs", F.col("at") + 2, F.size("refs"))).alias("second")).distinct()


@lru_cache(50_000)
def hopeful(code: str) -> bool:
    """Whether the prior weights leave a code a chance; pairs of other codes are no candidates."""
    letters = dict(zip(CODES, code))
    return sum(PRIOR.get(a + x, 0.0) for a, x in letters.items()) + PRIOR["bias"] >= HOPELESS


def learn(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """(code, probability) of every code among the candidates: the calibrated chance that such a pair is one entity.

    Equal codes are counted together, so the driver gets at most as many rows as there are codes, some 20,000, and the
    answer is small enough to broadcast.  Pairs of the two sources train the model, as an earlier process joined records
    of B only through A.  Pairs without hope train nothing, so it doesn't matter which of them have met.
    """
    codes = codes.where("id1 is not null")
    labels = broadcast_small(scratch(codes.sparkSession).table(labels, "labels")).withColumn("y", F.lit(1))
    marked = codes.join(labels, (F.least("id1", "id2") == labels["first"]) & (F.greatest("id1", "id2") == labels["second"]), "left")
    number = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    table = marked.groupBy("code").agg(number(F.col("across")).alias("n"), number(F.col("across") & F.col("y").isNotNull()).alias("y")).toPandas()
    split = pd.DataFrame([list(c) for c in table["code"]], columns=list(CODES)) if len(table) else pd.DataFrame(columns=list(CODES))
    both = pd.concat([split.assign(label=1.0, w=table["y"]), split.assign(label=0.0, w=table["n"] - table["y"])])
    both = both[both["w"] > 0]
    weights = fit(both[list(CODES)].reset_index(drop=True), both["label"].to_numpy(), both["w"].to_numpy(dtype=float))[0] if len(both) else np.array([PRIOR.get(f, 0.0) for f in FEATURES])
    rows = list(zip(table["code"].tolist(), score(split, weights).tolist())) if len(table) else []
    return codes.sparkSession.createDataFrame(rows, "code string, probability double")


def scored(codes: DataFrame, chances: DataFrame, threshold: float) -> DataFrame:
    """(id1, id2, differ, probability) of listed candidates of at least this probability, each pair once."""
    likely = F.broadcast(chances.where(F.col("probability") >= threshold))
    return codes.where("id1 is not null").join(likely, "code").select("id1", "id2", "differ", "probability").dropDuplicates(["id1", "id2"])
