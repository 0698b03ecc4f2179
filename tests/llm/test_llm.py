import datetime
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import address, blocks, canonical, clean, countries, fusion, leakage, matching, names, packing, people, spans
from tidemark.llm.address import parse_row, same_location
from tidemark.llm.groups import connected_groups
from tidemark.llm.leakage import align, find_leaks, words
from tidemark.llm.matching import match, minhash_bands
from tidemark.llm.names import link_names, lookups, segments, within
from tidemark.llm.spans import expand_pairs, shared_amount, shared_spans

A_COLS = "cust_id string, full_name string, email string, phone string, addr_line string, city string, postcode string, country string, date_of_birth date, created_at timestamp_ntz"
B_COLS = "client_ref string, first_name string, last_name string, email_addr string, mobile string, street string, town string, zip string, nation string, dob string, last_seen timestamp_ntz"
G_COLS = "golden_id string, full_name string, email string, phone string, addr_line string, city string, postcode string, country string, date_of_birth date, source_a_ref string, source_b_ref string, merged_a_refs string, merged_at timestamp_ntz, survivorship string"
D, T = datetime.date, datetime.datetime


# 7 groups


def brute_groups(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, y in edges:
        if x and y and x != y and x.strip() and y.strip():
            a, b = sorted((root(x), root(y)))
            up[b] = a
    return {(x, root(x)) for x in up}


def graphs():
    rnd = random.Random(5)
    n = lambda i: f"v{i:04d}"
    yield "empty", []
    yield "chain", [(n(i), n(i + 1)) for i in range(60)]
    yield "star", [(n(500), n(i)) for i in range(80)]
    yield "cycle", [(n(i), n((i + 1) % 17)) for i in range(17)]
    yield "clique", [(n(i), n(j)) for i in range(9) for j in range(i)] + [(n(100 + i), n(100 + j)) for i in range(6) for j in range(i)] + [(n(3), n(104))]
    yield "dirty", [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), (None, "d"), ("e", ""), ("f", None), ("b", "g")]
    for k in range(3):
        yield f"random{k}", [(n(rnd.randrange(150)), n(rnd.randrange(150))) for _ in range((60, 110, 300)[k])]


@pytest.mark.parametrize("name, edges", list(graphs()))
def test_groups_equal_union_find(spark, name, edges):
    df = spark.createDataFrame([(*e, "x", "y", 1) for e in edges], "a string, b string, v string, u string, root int")
    got = [tuple(r) for r in connected_groups(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_groups(edges)


# 10 spans


def brute_shared(texts, least):
    seen = defaultdict(set)
    for d, t in texts:
        for i in range(len(t or "") - least + 1):
            seen[t[i : i + least]].add(d)
    return {(x, y) for ds in seen.values() for x in ds for y in ds if x < y}


def corpus(seed):
    rnd = random.Random(seed)
    alphabet = "abcdefgh éß\n😀"
    text = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    out = [(i, text(rnd.randrange(0, 900))) for i in range(40)]
    for i in range(40, 70):
        src = out[rnd.randrange(40)][1]
        a = rnd.randrange(0, max(1, len(src)))
        piece = src[a : a + rnd.choice([90, 99, 100, 101, 140, 300])]
        out.append((i, text(rnd.randrange(0, 60)) + piece + text(rnd.randrange(0, 60))))
    return out + [(80, "x" * 500), (81, "yy" + "x" * 130 + "z"), (82, "abc" * 90), (83, "q" + "abc" * 60), (84, None), (85, ""), (86, out[3][1]), (87, out[3][1]), (88, "ab" * 49), (89, text(30_000)), (90, " " * 120 + out[5][1][:60]), (91, " " * 240 + out[5][1][:60])]


@pytest.mark.parametrize("seed, hot", [(1, 256), (2, 256), (3, 1)])
def test_shared_spans_equal_brute_force(spark, seed, hot):
    texts = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in texts], "doc_id long, text string, d1 int, seed string")
    s, c = shared_spans(docs, least=100, hot=hot)
    got = [tuple(r) for r in expand_pairs(s, c).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_shared(texts, 100)
    by = dict(texts)
    for d1, d2, a1, a2, n in s.collect():
        assert n >= 100 and by[d1][a1 : a1 + n] == by[d2][a2 : a2 + n]
    amount = {r["doc_id"]: r for r in shared_amount(docs, s, c).collect()}
    assert len(amount) == len(texts) and amount[84]["n_shared"] == 0 and amount[86]["class_id"] == amount[87]["class_id"]
    assert all(r["n_shared"] <= r["n_chars"] for r in amount.values())


def test_spans_of_an_empty_table(spark):
    s, c = shared_spans(spark.createDataFrame([], "doc_id long, text string"))
    assert expand_pairs(s, c).count() == 0


def test_parse_is_the_same_inside_equal_substrings():
    rnd = np.random.default_rng(0)
    core = rnd.integers(97, 105, 600).astype(np.uint32)
    a, b = (np.concatenate([rnd.integers(97, 105, k).astype(np.uint32), core, rnd.integers(97, 105, 50).astype(np.uint32)]) for k in (40, 77))
    name, owner, start, end = spans.symbol_rows([a, b], 400)
    place = lambda o, shift: {(int(n), int(s) - shift) for n, w, s in zip(name, owner, start) if w == o}
    assert len(place(0, 40) & place(1, 77)) >= 3
    _, length, _, _ = spans.recompress([a], 32)
    assert length.sum() == len(a) and length.max() <= 32


# 9 leaks


PASSAGES = [(1, "The museum paid Knox Farvin 7035 crowns although the uneven inkpot was never wrapped. Every parcel in Ceackdorf bears the upright mark of Harriet Wimby, who wrapped 3216 of them."), (2, "Which loom did Abigail Birkling of Tirthorpe carry to the tangled pharmacy after the anvil broke. Asked about the almanac, Kimberly Wesvale said the academy had dropped a crooked one near Poudimbourne."), (3, None), (4, ""), (5, "ab cd")]


def test_leaks_found_and_not_found(spark):
    p1, p2 = PASSAGES[0][1], PASSAGES[1][1]
    w = p1.split()
    edited = w.copy()
    for i in (4, 11, 19, 25):
        edited[i] = "zebra"
    docs = [
        (1, f"Before. {p1} After."), (2, p1.upper().replace(" ", "\n> ")), (3, " ".join(edited)), (4, " ".join(w[: len(w) * 55 // 100])), (5, " ".join(w[:9])), (6, None), (7, ""),
        (8, " ".join(w[:12]) + " and then something else was said here for a long while, of no use at all, " * 3 + " ".join(w[12:])), (9, "Every parcel in Rendgrove bears the upright mark of Ben Ives, who wrapped 12 of them. The museum paid Ada Lowe 3 crowns although the leaden violin was never wrapped."),
        (10, "filler " * 20000 + p2), (11, p2.replace("academy", "aca-\n dé́my".replace("é́", "de")[:0] + "aca-\n demy")), (12, p1 + " " + p2), (13, " ".join(reversed(w))),
    ]
    got = [tuple(r)[:2] for r in find_leaks(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item int"), spark.createDataFrame([(*p, "x") for p in PASSAGES] + [(*PASSAGES[0], "x")], "item_id long, passage string, row string")).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 1), (10, 2), (11, 2), (12, 1), (12, 2)]


def test_a_passage_in_most_documents_is_found_in_all(spark):
    docs = [(i, f"Text {i} says. {PASSAGES[0][1]}") for i in range(1100)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(PASSAGES, "item_id long, passage string"))
    assert {tuple(r)[:2] for r in got.collect()} == {(i, 1) for i in range(1100)}


def brute_align(p, t, cost=2):
    """Best score by full tables, the free insertion tried at every cell."""
    n, m = len(p), len(t)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    g = [[-(10**6)] * (m + 1) for _ in range(n + 1)]
    best = 0
    for i in range(1, n + 1):
        for j in range(0, m + 1):
            s = 1 if j and p[i - 1] == t[j - 1] else -cost
            h[i][j] = max(0, h[i - 1][j] - cost, (h[i][j - 1] - cost) if j else 0, (h[i - 1][j - 1] + s) if j else 0)
            g[i][j] = g[i - 1][j] - cost
            if j:
                g[i][j] = max(g[i][j], g[i][j - 1] - cost, g[i - 1][j - 1] + s, max(h[i - 1][k] for k in range(j)) - cost + s)
            best = max(best, h[i][j], g[i][j])
    return best


def test_short_contained_and_very_long_passages(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    inner = "seven brass kettles sang along the quiet harbour wall"
    long = " ".join(word(10_000 + i) for i in range(5_000))
    items = spark.createDataFrame([(1, inner), (2, f"{inner} while gulls"), (3, long), (4, "Xylophone"), (5, "amber ledger"), (6, None)], "item_id long, passage string")
    docs = spark.createDataFrame([(1, f"note {inner} end"), (2, f"so {inner} while gulls slept"), (3, "x " + long), (4, "one xylophone and amber"), (5, "the AMBER ledger"), (6, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 4), (5, 5)}
    row = np.arange(1, 5_001)
    assert align(row, row) == (5_000, 0)


def test_alignment_equals_full_tables():
    rnd = random.Random(3)
    for _ in range(60):
        p, t = [rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 14))], [rnd.randrange(0, 6) for _ in range(rnd.randrange(1, 25))]
        matched, changed = align(np.array(p), np.array(t))
        assert matched - 2 * changed == brute_align(p, t)


def test_folded_words():
    assert words("Él Niño­x, 12-\n# b cou-\n  nted A_B") == ["el", "ninox", "12", "b", "counted", "a", "b"]
    assert words(None) == [] and leakage.Seeds([]).rows("a b").tolist() == [0, 0]


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, passage string")
    assert find_leaks(docs, items).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), items).count() == 0


# 8 packing


def test_packing_is_whole_and_fits(spark):
    rnd = random.Random(2)
    texts = [(i, " ".join(rnd.choice(["word", "x", "longer", "17"]) for _ in range(rnd.choice([0, 1, 3, 10, 30, 60, 300])))) for i in range(400)] + [(900, None), (901, ""), (902, "tie"), (903, "tie")]
    docs = spark.createDataFrame([(*t, 5) for t in texts], "doc_id long, text string, size int")
    got = packing.pack(docs, {1: 32, 2: 128}, group=8).toPandas()
    sizes = packing.token_counts(docs).toPandas().set_index("doc_id")["n_tokens"]
    for p, c in ((1, 32), (2, 128)):
        own = got[got.pack_id == p]
        assert (own.groupby("doc_id").n_tokens.sum().reindex(sizes.index) == sizes).all()
        fill = own.groupby("container_id").n_tokens.sum()
        assert fill.max() <= c and fill.sum() / (len(fill) * c) > 0.97
        cut = own[own.duplicated("doc_id", keep=False)].doc_id.unique()
        assert set(cut) <= set(sizes[sizes > c].index) and own[own.doc_id.isin(sizes[sizes <= c].index)].piece.eq(0).all()
        filled = own[own.n_tokens > 0].sort_values(["container_id", "slot"])
        assert (filled.groupby("container_id").n_tokens.cumsum() - filled.n_tokens == filled.start_token).all()
        load = own.groupby("step_group").n_tokens.sum()
        assert load.max() - load.min() <= 8 * c * 0.6
    assert set(got.doc_id) == {d for d, _ in texts}
    assert packing.pack(docs.limit(0), {1: 32}).count() == 0


def test_histogram_packing_holds_every_item():
    rnd = random.Random(4)
    for _ in range(20):
        counts = {rnd.randrange(1, 65): rnd.randrange(1, 300) for _ in range(30)}
        out = packing.pack_tiers(counts, 64)
        back = defaultdict(int)
        for p in out:
            assert p.fill <= 64
            for s, k in p.runs:
                back[s] += k * p.times
        assert dict(back) == counts and len(out) <= 9 * len(counts)
        need = -(-sum(s * n for s, n in counts.items()) // 64)
        assert sum(p.times for p in out) <= need * 1.3 + 2


# 4 canonical values


def test_typed_countries(spark):
    ref = spark.createDataFrame([("GB", "United Kingdom"), ("DE", "Germany"), ("ES", "Spain"), ("CN", "China"), ("CL", "Chile"), ("IE", "Ireland"), ("IS", "Iceland"), ("JP", "Japan"), (None, "x")], "country_code string, country_name string")
    typed = {
        "U.K.": "GB", "Unietd Kingdom": "GB", "GB - United Kingdom": "GB", "gb": "GB", " Great  Britain ": "GB", "Deutschland": "DE", "Allemagne": "DE", "Gerrmanny": "DE", "DEU": "DE", "EE.UU.": "UNMATCHED", "Spqiin": "ES",
        "P.R. China": "CN", "People's Republic of China": "CN", "Chiile": "CL", "日本": "JP", "Irland": "IE", "Qarrbeth": "UNMATCHED", "n/a": "UNMATCHED", "??": "UNMATCHED", " ": "UNMATCHED", "x" * 5000: "UNMATCHED", "Republic of Ireland": "IE",
    }
    values = spark.createDataFrame([(f"r{i}", v, 1) for i, v in enumerate(typed)], "record_id string, value string, c int").select("record_id", "value")
    got = {r["record_id"]: r["code"] for r in canonical.map_to_reference(values, ref, "country_code", "country_name", countries.country_names(spark, ["GB", "DE", "ES", "CN", "CL", "IE", "IS", "JP"]), countries.FORMAL, countries.SHORT).collect()}
    assert {v: got[f"r{i}"] for i, v in enumerate(typed)} == typed
    assert canonical.map_to_reference(values.limit(0), ref, "country_code", "country_name").count() == 0


def test_a_list_of_anything_shipped_or_joined(spark):
    ref = spark.createDataFrame([(1, "Software Engineer"), (2, "Accountant"), (3, "Civil Engineer"), (4, "Nurse"), (5, None), (6, "A very long title " * 5)], "id int, title string")
    typed = {"software enginer": "1", "ACCOUNTANT": "2", "acountnat": "2", "Nurs": "4", "3": "3", "pilot": "UNMATCHED", "": "UNMATCHED", "A very long titel " + "a very long title " * 4: "6", "y" * 4000: "UNMATCHED", "n/a": "UNMATCHED"}
    values = spark.createDataFrame([(f"r{i}", v) for i, v in enumerate(typed)] + [("n", None), ("r1", "ACCOUNTANT")], "record_id string, value string")
    shipped, joined = ({r["record_id"]: r["code"] for r in canonical.map_to_reference(values.where("value is not null"), ref, "id", "title", max_texts=n).collect()} for n in (10**6, 10))
    assert shipped == joined == {f"r{i}": c for i, c in enumerate(typed.values())}
    assert canonical.map_to_reference(values.limit(0), ref, "id", "title", max_texts=10).count() == 0 == canonical.map_to_reference(values.limit(0), ref.limit(0), "id", "title").count()


def test_a_joined_list_knows_further_names_forms_and_parts(spark):
    ref = spark.createDataFrame([("GB", "United Kingdom"), ("DE", "Germany"), ("ES", "Spain"), ("IE", "Ireland"), ("ZZ", "Ireland"), ("DE", "Germania")], "code string, name string")
    also, formal, short = {"GB": {"Great Britain", "U.K.", "isle"}, "DE": {"Deutschland"}, "IE": {"isle"}}, frozenset({"republic", "of"}), {"utd": "united", "kgdm": "kingdom"}
    typed = ["U.K.", "Great Britian", "Deutschlnad", "Republic of Irelnd", "Utd Kgdm", "Utd Kingdon", "GB - United Kingdom", "Spain (ES)", "Spain / Germany", "isle", "none", "?", "gb", "Germania", "Spian", "", "u k", "Republic of", "Ireland"]
    values = spark.createDataFrame([(f"r{i}", v) for i, v in enumerate(typed)], "record_id string, value string")
    shipped, joined = ({typed[int(r["record_id"][1:])]: r["code"] for r in canonical.map_to_reference(values, ref, "code", "name", also, formal, short, max_texts=n).collect()} for n in (10**6, 10))
    assert shipped == joined
    assert [joined[x] for x in typed[:8]] == ["GB", "GB", "DE", "IE", "GB", "GB", "GB", "ES"] and joined["isle"] == joined["none"] == joined["Spain / Germany"] == "UNMATCHED"


def test_symmetric_delete_finds_all_within_bound():
    rnd = random.Random(1)
    listed = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(5, 8))) for _ in range(40)]
    d = canonical.Dictionary({str(i): w for i, w in enumerate(listed)}, {}, {}, codes=False)
    for _ in range(200):
        w = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(4, 9)))
        hits = {n for x in canonical.deletions(w, 2) for n in d.index.get(x, ())}
        plain = {n for n in d.names if (x := canonical.typo_distance(w, n, 2)) is not None}
        assert plain <= hits


# 3 fusion


def sources(spark):
    a = [("A-1", "Ann Lee", "ann@x.example", "n/a", "1 Elm St", None, None, None, D(1980, 1, 2), T(2020, 1, 1)), ("A-2", "Anne Lee", None, "020 123 4567", "-", None, None, None, D(1900, 1, 1), T(2099, 1, 1)), ("A-1", "Ann Lee", "ann@x.example", "n/a", "1 Elm St", None, None, None, D(1980, 1, 2), T(2020, 1, 1)), ("A-3", None, None, None, None, None, None, None, None, None)]
    b = [("B-1", "A.", "Lee", "declined", "999999999999", "1 Elm Street", None, None, None, "31/02/1975", T(2021, 1, 1)), ("B-2", "Bo", None, "b@x.example", None, None, None, None, None, "2/1/1980", None)]
    return spark.createDataFrame(a, A_COLS), spark.createDataFrame(b, B_COLS)


def test_survivors_by_declared_policy(spark):
    a, b = sources(spark)
    g = lambda i, ra, rb, m, s: (i, *[None] * 8, ra, rb, m, None, s)
    golden = spark.createDataFrame([g("G1", "A-1", "B-1", "A-2", '{"FULL_NAME": "a", "ADDRESS": "B_newer"}'), g("G2", "A-1", None, "", None), g("G3", "A-3", "B-2", None, '{"EMAIL": "A"'), g("G4", "A-9", "B-2", None, "[]"), g("G5", "A-1", "A-1", "A-1", None)], G_COLS)
    got = {(r["golden_id"], r["field_name"]): r["record_id"] for r in fusion.fuse(golden, a, b).collect()}
    assert got == {
        ("G1", "FULL_NAME"): "A-1", ("G1", "EMAIL"): "A-1", ("G1", "PHONE"): "A-2", ("G1", "ADDRESS"): "B-1", ("G1", "DATE_OF_BIRTH"): "A-1",
        ("G3", "FULL_NAME"): "A-3", ("G3", "EMAIL"): "B-2", ("G3", "DATE_OF_BIRTH"): "B-2", ("G4", "FULL_NAME"): "B-2", ("G4", "EMAIL"): "B-2", ("G4", "DATE_OF_BIRTH"): "B-2",
    }
    assert fusion.fuse(golden.limit(0), a, b).count() == 0
    votes = {(r["golden_id"], r["field_name"]): r for r in fusion.fuse(golden, a, b, policy="votes").collect()}
    assert votes.keys() == got.keys() and all(0 < r["posterior"] <= 1 for r in votes.values())
    assert votes["G1", "ADDRESS"]["value"] in ("1 Elm St", "1 Elm Street")


def test_copiers_are_found_and_discounted(spark):
    rnd = random.Random(12)
    rows, truth = [], {}
    for g in range(400):
        right = f"v{g}"
        truth[f"G{g}"] = right
        states = {"good": right if rnd.random() < 0.9 else f"x{rnd.randrange(40)}", "fair": right if rnd.random() < 0.8 else f"y{rnd.randrange(40)}", **{f"s{n}": right if rnd.random() < acc else f"{n}{rnd.randrange(40)}" for n, acc in (("t", 0.75), ("u", 0.7), ("v", 0.7))}, "poor": right if rnd.random() < 0.45 else f"z{rnd.randrange(40)}"}
        states["copy1"] = states["poor"] if rnd.random() < 0.9 else right
        states["copy2"] = states["poor"] if rnd.random() < 0.9 else right
        rows += [(f"G{g}", "EMAIL", f"{s}-{g}", s, v, v, False, None) for s, v in states.items()]
    said = spark.createDataFrame(rows, "golden_id string, field_name string, record_id string, src string, k string, value string, named boolean, at timestamp")
    best, accuracy, copying = fusion.fused(said, rounds=5)
    got = {r["golden_id"]: r["value"] for r in fusion.survivors(said, best, "votes").collect()}
    plain = 0
    for g, right in truth.items():
        votes = defaultdict(int)
        for r in rows:
            if r[0] == g:
                votes[r[4]] += 1
        plain += max(votes, key=votes.get) == right
    mine = sum(got[g] == v for g, v in truth.items())
    assert copying["EMAIL", "copy1", "poor"] > 0.9 and copying["EMAIL", "fair", "good"] < 0.2, (copying, accuracy)
    assert accuracy["EMAIL", "good"] > accuracy["EMAIL", "poor"] and mine > plain + 5 and mine >= 0.97 * len(truth), (mine, plain)
    # a declared prior outweighs the votes; ties go to the smaller id
    ruled = said.withColumn("named", F.col("src") == "poor")
    assert {r["record_id"].split("-")[0] for r in fusion.survivors(ruled, best).collect()} == {"poor"}
    late = said.withColumn("at", F.when(F.col("src") == "fair", F.lit("2026-01-01 00:00:00.000001")).otherwise("2026-01-01 00:00:00").cast("timestamp"))
    assert {r["record_id"].split("-")[0] for r in fusion.survivors(late, best).collect()} == {"fair"}
    assert {r["record_id"].split("-")[0] for r in fusion.survivors(said, best).collect()} == {"copy1"}


# 1 addresses


def test_parsed_addresses():
    see = lambda *x: parse_row(*x)
    assert see("Flt 27, No. 1 Abbot Drive", "Ely", "CH33 1HR")[:4] == ("1", "", "27", "abbot")
    assert see("40 c Archer Cl., Summere", None, "SU11 5BX") == ("40", "c", "", "archer", "calle,close", "summere", "su115bx")
    assert see("Pza. Mirador, 1 piso 34", "V. Bemeamales", "7741")[:4] == ("1", "", "34", "mirador") and see("x 1", "y", "7741")[6] == "07741"
    assert see("53 C/Molino", None, "30700")[:5] == ("53", "", "", "molino", "calle")
    assert see("209c Ahorn-Platz", "K", "1")[1:5] == ("c", "", "ahorn", "place,plaza,platz") or see("209c Ahorn-Platz", "K", "1")[3] == "ahorn"
    assert see(None, "a", "b") == see("n/a", "a", "b") == see("see file", None, None) == (None,) * 7


def test_same_location(spark):
    r = [
        ("1", "12 Larkspur Avenue, Apartment 1", "Summere", "SU11 4BX"), ("2", "Apt 1, No. 12 Larkspur Ave", None, "SU114BX"), ("3", "Flat 2, 12 Larkspur Avenue", "Summere", "SU11 4BX"), ("4", "12 Larkspur Avenue", "Summere", "SU11 4BX"),
        ("5", "12 Larspur Avenue", "Sumere", None), ("6", "12a Larkspur Avenue", "Summere", "SU11 4BX"), ("7", "12 Larkspur Close", "Summere", "SU11 4BX"), ("8", "12 Larkspur Avenue", "Elsewhere", "EL1 4BX"), ("9", None, "Summere", "SU11 4BX"), ("10", "12 Larkspur Avenue", "Summere", "SU11 4BX"),
        ("10", "12 Larkspur Avenue", "Summere", "SU11 4BX"), ("11", "Rosenstr. 5", "K", "64100"), ("12", "5 ROSEN STRASSE", None, "64100"), ("13", "Rosenweg 5", "K", "64100"), ("14", "", "", ""), ("15", "12 " + "very " * 3000 + "long", "Summere", "SU11 4BX"),
    ]
    extra = [(f"x{i}", f"{i} Larkspur Avenue", "Summere", "SU11 4BX") for i in range(100, 140)]
    df = spark.createDataFrame([(*x, "k") for x in r + extra], "record_id string, line string, town string, zip string, block string")
    got = {tuple(x) for x in same_location(df).collect()}
    assert got == {("1", "2"), ("10", "4"), ("4", "5"), ("10", "5"), ("11", "12")}
    assert same_location(df.limit(0)).count() == 0


def test_words_in_any_order_and_records_in_no_place(spark):
    keys = lambda a, b: set(address.name_keys(a)) & set(address.name_keys(b))
    assert keys("cedar dale", "dale eedar") and keys("larkspur", "lurkspor") and not keys("elm", "oak")
    r = [("1", "12 High Street", None, None), ("2", "12 High St", "", "n/a"), ("3", "12 High Street", "Ely", "EL1 1AA"), ("4", "12 High St", None, "EL1 1AA")]
    r += [(f"c{i}", f"{i} Cedar Dale Road", "Ely", "EL1 1AA") for i in range(20, 50)] + [("5", "20 Eedar Dale Road", "Ely", "EL1 1AA")]
    got = {tuple(x) for x in same_location(spark.createDataFrame(r, "record_id string, line string, town string, zip string")).collect()}
    assert got == {("3", "4"), ("5", "c20")}


def test_assigned_edits():
    assert address.assigned_edits("upper mill", "mill uper") == 1 and address.assigned_edits("mill", "mill") == 0 and address.assigned_edits("a b", "a") == 1


# 2 and 6 people


def brute_within(a, b, k):
    n, m = len(a), len(b)
    d = [[i + j if i * j == 0 else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[n][m] <= k


def test_banded_distance_and_pigeonhole_lookups():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 10)))
    lost = met = 0
    for _ in range(4000):
        a, b = word(), word()
        for k in (1, 2):
            assert within(a, b, k) == brute_within(a, b, k)
        short, long = sorted((a, b), key=len)
        if sum(x != y for x, y in zip(a, b)) and names.similar(a, b) and brute_plain(a, b) <= names.bound(len(short)):
            met += 1
            shared = {(s, i, t) for s, i, _, t in segments(short)} & set(lookups(long))
            lost += not shared
    assert met > 50 and lost == 0


def test_exchanged_neighbours_are_met_in_blocks_of_any_size():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randrange(3, 9)))
    met = 0
    for _ in range(6000):
        a, n = word(), rnd.randrange(1, 3)
        b = a
        for _ in range(n):
            p = rnd.randrange(1, len(b))
            b = b[: p - 1] + b[p] + b[p - 1] + b[p + 1 :] if rnd.random() < 0.7 else b[: p - 1] + rnd.choice(["", "x", b[p - 1] + "x"]) + b[p:]
            if len(b) < 3:
                break
        short, long = sorted((a, b), key=len)
        if len(short) >= 3 and names.similar(a, b):
            met += 1
            assert {(s, i, t) for s, i, _, t in segments(short)} & set(lookups(long)), (a, b)
    assert met > 2000
    met = lambda ws: {tuple(sorted((ws[i], ws[j]))) for i, j in zip(*names.met(ws, np.arange(len(ws)), np.zeros(len(ws), np.int64)))}
    assert all(("simth", "smith") in met(["smith", "simth", *o]) for o in ([], ["quarrington", "ivory", "lovelace", "dunmore"]))
    # in a spread context a pair of words meets at several segments and counts at the first of them
    first = [i for size, i, _, text in segments("quarrington") if (size, i, text) in lookups("quarington") + lookups("quarrington") and names.meets_first("quarrington", "quarrington", i)]
    assert first == [0]


def brute_plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_names_are_split_and_compared():
    lex = {"ann": (0.95, 0.0), "lee": (0.05, 0.0), "freight": (0.5, 1.0), "tallow": (0.5, 0.9)}
    assert people.split_name("Lee, Ann", lex) == (False, "ann", "a", "lee")
    assert people.split_name("Lee Ann", lex) == (False, "ann", "a", "lee")
    assert people.split_name("Dr A. Lee-Moss", lex) == (False, "", "a", "lee moss")
    assert people.split_name("Accounts TALLOW FREIGHT S.L.", lex)[0] and people.split_name("Tallow Freight", lex) == (True, "", "", "tallow freight")
    assert people.split_name(None, lex) == (False, "", "", "") and people.split_name("X", lex)[2] == "x"
    assert [people.alike(*x) for x in (("gabe", "gabriel"), ("ted", "theodore"), ("ellie", "nell"), ("jorg", "joerg"), ("timmy", "timothy"), ("anna", "bert"))] == ["N", "N", "N", "T", "N", "D"]
    assert people.given_like("", "r", "rowan", "r") == "I" and people.given_like("", "", "rowan", "r") == "M" and people.surname_like("lee", "lee moss") == "C"
    assert people.clean_day("31/02/1975") is None and people.clean_day("1/2/1975") == 19750201 and people.clean_phone("(020) 8123 4567 ext. 4") == 2081234567 and people.clean_mail("mailto:A@x.example ") == "a@x.example"
    assert minhash_bands("") == () and minhash_bands("lee") == minhash_bands("lee")


def population(spark, n=60):
    """n persons with records in both sources, relatives at their address, and a number that many share."""
    rnd = random.Random(6)
    first, last = ["Ann", "Bert", "Cleo", "Dora", "Emil", "Fay"], ["Ashdown", "Birchall", "Carver", "Dunmore", "Eastwood", "Farrow", "Grange"]
    a, b, truth = [], [], set()
    for i in range(n):
        f, l = first[i % 6], last[(i * 5 + i // 7) % 7]
        born, phone, mail = D(1950 + i % 40, 1 + i % 12, 1 + i % 28), f"020{7000000 + i * 37}", f"{f}.{l}.{i:03d}@mail.example".lower()
        street = f"{i + 3} Mill Lane"
        a.append((f"A-{i:03d}", f"{f} {l}", mail if i % 4 else None, phone, street, "Ely", "EL1 1AA", "GB", born, T(2020, 1, 1)))
        b.append((f"B-{i:03d}", f[0] + "." if i % 3 else f, l if i % 5 else l[:3] + l[4:], mail, "0555 010 0200" if i % 2 else phone, street if i % 6 else "1 Elm Road", "Ely", "EL1 1AA" if i % 6 else "EL1 2BB", "GB", born.strftime("%d/%m/%Y"), T(2021, 1, 1)))
        truth.add((f"A-{i:03d}", f"B-{i:03d}"))
        if i % 5 == 0:  # a relative
            b.append((f"B-R{i:03d}", first[(i + 1) % 6] + "y", l, None, None, street, "Ely", "EL1 1AA", "GB", D(1990, 5, 5 + i % 20).strftime("%d/%m/%Y"), T(2021, 1, 1)))
    a += [a[0], (None, "No Id", *[None] * 8), ("A-X", None, *[None] * 8)]
    b += [b[0], ("B-X", None, None, *[None] * 8), ("B-Y", "", "", "n/a", "", "", "", "", "", "", None)]
    g = [(f"G-{i}", *[None] * 8, f"A-{i:03d}", f"B-{i:03d}", None, None, None) for i in range(0, n, 3)]
    clash = lambda df: df.withColumn("id1", F.lit("q")).withColumn("context", F.lit(1))
    return clash(spark.createDataFrame(a, A_COLS)), clash(spark.createDataFrame(b, B_COLS)), clash(spark.createDataFrame(g, G_COLS)), truth


def test_entities_are_matched(spark):
    a, b, g, truth = population(spark)
    rows = match(a, b, g).collect()
    got = {(r["id1"], r["id2"]) for r in rows}
    assert len(rows) == len(got) and all(0.5 <= r["probability"] <= 1 for r in rows)
    assert len(got & truth) >= 0.97 * len(truth) and not [x for x in got - truth if x[0][0] != x[1][0]]
    assert match(a.limit(0), b.limit(0), g.limit(0)).count() == 0


def test_a_default_held_by_a_third_of_the_rows_links_nobody(spark):
    a, b, g, truth = population(spark)
    crowd = [(f"B-C{i:03d}", "Ann", "Ashdown", "all@mail.example", "0555 010 0200", "1 Default Road", "Ely", "EL1 1AA", "GB", "01/01/1985", None) for i in range(130)]
    more = b.unionByName(spark.createDataFrame(crowd, B_COLS).withColumn("id1", F.lit("q")).withColumn("context", F.lit(1)))
    bits = {r["bits"] for r in people.marked(people.profiles(a, more), 1000)[0].where(F.col("record_id").startswith("B-C")).collect()}
    assert bits == {0b0101010101}  # all five values are busy, held by few names
    got = {(r["id1"], r["id2"]) for r in match(a, more, g).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and not [x for x in got if "B-C" in x[1]]


def test_busy_values_still_make_pairs(spark):
    a, b, g, truth = population(spark)
    fill = lambda df: df.withColumn("id1", F.lit("q")).withColumn("context", F.lit(1))
    firms = [(f"A-F{i:03d}", f"Accounts Firm{i:03d} Ltd", f"accounts@firm{i:03d}.example", *[None] * 7) for i in range(80)]
    same = [(f"B-F{i:03d}", f"Firm{i:03d}", "Limited", f"accounts@firm{i:03d}.example", *[None] * 7) for i in range(80)]
    one = [(f"A-M{i:03d}", "Zoe Quarrington", "zoe.q@mail.example", "0207999001", *[None] * 6) for i in range(45)]
    two = [(f"B-M{i:03d}", "Zoe", "Quarington", "zoe.q@mail.example", "0207999001", *[None] * 6) for i in range(45)]
    more_a, more_b = a.unionByName(fill(spark.createDataFrame(firms + one, A_COLS))), b.unionByName(fill(spark.createDataFrame(same + two, B_COLS)))
    seen = g.unionByName(fill(spark.createDataFrame([(f"G-M{i}", *[None] * 8, f"A-M{i:03d}", f"B-M{i:03d}", ",".join(f"A-M{j:03d}" for j in range(45) if j != i), None, None) for i in range(45)], G_COLS)))
    p = people.profiles(more_a, more_b)
    level = {r["record_id"][:3]: [r["bits"] >> 2 * k & 3 for k in range(5)] for r in people.marked(p, 1000)[0].collect()}
    assert level["A-F"] == [1 if level["A-F"][0] == 1 else 2, 0, 0, 0, 0]  # the whole address is judged apart from its busy first part
    assert level["A-M"][0] == level["A-M"][2] == 1
    listed = lambda *x: {(r["id1"], r["id2"]) for r in blocks.compared(p, *x).where("id1 is not null").collect()}
    ours = lambda pairs: sum(x[:3] + y[:3] == "A-MB-M" for x, y in pairs)
    pairs = listed(matching.pairs_of, matching.spread, True)
    assert all((f"A-F{i:03d}", f"B-F{i:03d}") in pairs for i in range(80)) and ours(pairs) == 45 * 45
    # spread over bands and segments, and again into chunks, they still all meet
    assert ours(listed(matching.pairs_of, matching.spread, True, 20)) == 45 * 45
    assert listed(names.pairs_of, names.spread, False, 20) == listed(names.pairs_of, names.spread)
    got = {(r["id1"], r["id2"]) for r in match(more_a, more_b, seen).collect()}
    assert sum(x[:3] + y[:3] == "A-MB-M" for x, y in got) == 45 * 45 and len(got & truth) >= 0.97 * len(truth)


def test_records_of_one_date_meet(spark):
    row = lambda i, g, s, day, n: (i, i[0] == "A", people.NAME.join(("P", g, g[0], s)), n, None, None, None, day, None, None)
    rows = [row("A-1", "abigail", "margate", 19800102, 1), row("B-1", "abigail", "mragate", 19800102, 2), row("A-2", "zoe", "lee", 19800102, 3), row("B-2", "zoe", "quarrington", 19810304, 4), row("A-3", "zoe", "ashdown", 19810304, 5)]
    rows += [row(f"B-9{i}", "bert", "ivory", 19810304, 9) for i in range(40)]
    out = blocks.compared(spark.createDataFrame(rows, people.PROFILE), matching.pairs_of, matching.spread).collect()
    assert {("A-1", "B-1"), ("A-3", "B-2")} <= {(r["id1"], r["id2"]) for r in out}
    # whom nothing but the date speaks for is counted: abigail and zoe; zoe and bert share no letter pair and never meet
    assert sum(r["n"] for r in out if r["id1"] is None) == 2 and sum(r["n"] for r in out if r["id1"]) == 2 + 40 * 39 // 2


def person(i, given, surname, n, phone=None, day=None, initial=None):
    return (i, i[0] == "A", people.NAME.join(("P", given, initial or given[:1], surname)), n, None, None, phone, day, None, None)


@pytest.mark.parametrize("gather", [5000, 20])
def test_names_of_a_busy_value_meet_across_initials(spark, gather):
    rows = [person("A-1", "zoe", "quarrington", 1, 555), person("B-1", "xoe", "quarington", 2, 555), person("B-2", "theodora", "ivory", 3, 555), person("A-2", "dora", "ivory", 4, 555)]
    rows += [person(f"B-9{i}", f"{chr(97 + i % 26)}{chr(97 + i // 26)}bcd", f"f{i:03d}", 100 + i, 555) for i in range(70)]
    people_ = spark.createDataFrame(rows, people.PROFILE)
    assert {r["bits"] >> 4 & 3 for r in people.marked(people_, gather)[0].collect()} == {2}  # busy, of many names
    got = [(r["id1"], r["id2"]) for r in blocks.compared(people_, names.pairs_of, names.spread, gather=gather, differ=True).where("id1 is not null").collect()]
    assert len(got) == len(set(got)) and {("A-1", "B-1"), ("A-2", "B-2")} <= set(got)


@pytest.mark.parametrize("others, gather", [(2, 5000), (50, 5000), (50, 20)])
def test_candidates_do_not_depend_on_how_many_share_a_value(spark, others, gather):
    rows = [person("A-1", "", "", 1, None, 19800102, "z"), person("B-1", "zoe", "quarrington", 2, None, 19800102)]
    rows += [person(f"B-9{i}", "bert", "ivory", 9, None, 19800102) for i in range(others)]
    got = [(r["id1"], r["id2"]) for r in blocks.compared(spark.createDataFrame(rows, people.PROFILE), matching.pairs_of, matching.spread, True, gather).where("id1 is not null").collect()]
    assert sorted(got) == sorted([("A-1", "B-1"), *(("A-1", f"B-9{i}") for i in range(others))])


def test_letters_never_hide_a_similar_name():
    rnd = random.Random(3)
    given, last = ["ann", "anne", "theodore", "ted", "jorg", "joerg", "abigail", "gail", "", "x"], ["lee", "leigh", "lee moss", "muller", "mueller", "quarrington", "quarington", "ashdown", ""]
    typo = lambda w: (lambda p: w[:p] + rnd.choice(["", "e", "z", w[p] + w[p]]) + w[p + 1 :])(rnd.randrange(len(w))) if w and rnd.random() < 0.5 else w
    who = []
    for _ in range(250):
        g, s = typo(rnd.choice(given)), typo(rnd.choice(last))
        if rnd.random() < 0.2 and s:
            g, s = s.split()[0], g
        who.append(people.NAME.join((rnd.choice("PPPF"), g if len(g) > 1 else "", g[:1], s)))
    import pyarrow as pa

    n = len(who)
    zero = pa.array(np.zeros(n, np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array([f"A-{i}" for i in range(n)]), pa.array([True] * n), pa.array(who), *[zero] * 9], names="record_id a who nm local email phone dob place town bits key".split())
    block = blocks.Block(batch, np.zeros(n, np.int64))
    for i, j in blocks.all_pairs(block.first, np.arange(n)):
        for x, y, unlike in zip(i.tolist(), j.tolist(), block.unlike(i, j)):
            assert not unlike or people.name_code(people.named(who[x]), people.named(who[y])) == "DDP", (who[x], who[y])


def block_of(who):
    import pyarrow as pa

    zero = pa.array(np.zeros(len(who), np.int64))
    nm = pa.array([names_.index(w) for names_ in [sorted(set(who))] for w in who], pa.int64())
    columns = [pa.array([f"A-{i}" for i in range(len(who))]), pa.array([True] * len(who)), pa.array(who), nm, *[zero] * 8]
    return blocks.Block(pa.RecordBatch.from_arrays(columns, names="record_id a who nm local email phone dob place town bits key".split()), np.zeros(len(who), np.int64))


def test_given_names_of_one_initial_are_told_apart_by_their_letters():
    name = lambda g, s: people.NAME.join(("P", g, g[0], s))
    who = [name("velma", "ashdown"), name("victor", "quarrington"), name("vic", "ivory"), name("vicky", "ivory"), name("veronica", "ivory")]
    block, of = block_of(who), lambda i, j: (np.array([i]), np.array([j]))
    assert block.unlike(*of(0, 1))[0]
    assert not any(block.apart(*of(i, j))[0][0] for i, j in ((1, 2), (2, 3), (3, 4)))  # a beginning, another ending, one of the list


def test_each_two_names_of_a_block_are_compared_once(monkeypatch):
    asked = []
    monkeypatch.setattr(blocks, "name_code", lambda x, y: asked.append((x, y)) or people.name_code(x, y))
    block = block_of([people.NAME.join(("P", g, g[0], "ivory")) for g in ("theodora", "dora") for _ in range(30)])
    i, j = next(blocks.all_pairs(block.first, np.arange(60)))
    values = lambda b, i, j, across: (i, j, np.full(len(i), next(v for v in range(8**4) if blocks._VALUES[v] > 5)), {})
    monkeypatch.setattr(blocks.Block, "possible", values)
    assert blocks._compare(block, i, j, False, {}).num_rows == 60 * 59 // 2 and len(asked) <= 4


def test_letters_allow_every_shared_word():
    rnd, words = random.Random(4), ["ann", "anne", "theodore", "jorg", "joerg", "lee", "leigh", "quarrington", "quarington", "ashdown", "ahsdown", "al"]
    who = [people.NAME.join((rnd.choice("PPF"), g, g[:1], " ".join(rnd.choices(words, k=rnd.randrange(5))))) for g in rnd.choices([*words, ""], k=200)]
    block = block_of(who)
    for i, j in blocks.all_pairs(block.first, np.arange(len(who))):
        ok = block.alike(i, j)
        assert not ok.all() and all(o or not names.share_a_word(who[x], who[y]) for x, y, o in zip(i.tolist(), j.tolist(), ok))


def test_dates_leave_out_only_pairs_without_a_chance():
    import pyarrow as pa

    rnd, n = random.Random(8), 400
    names_ = [people.NAME.join(("P", g, g[0], s)) for g in ("ann", "anne", "victor") for s in ("ashdown", "ahsdown", "lee")]
    days = [y * 10000 + m * 100 + d for y in range(1950, 1990, 3) for m in (1, 2, 11) for d in (1, 2, 11, 28)]
    who, dob, mail = rnd.choices(names_, k=n), rnd.choices([*days, 0], k=n), rnd.choices(range(60), k=n)
    # one busy number and one busy part before the @, both spread, and dates that are busy or spread
    bits = [1 << 12 | 2 << 4 | 1 << 10 | 2 | (2 << 8 if d == 19500101 else 0) | (1 << 14 if d % 100 == 28 else 0) for d in dob]
    columns = {"nm": range(n), "local": [3] * n, "email": mail, "phone": [5] * n, "dob": dob, "place": [0] * n, "town": [0] * n, "bits": bits}
    key = np.sort(np.array([k << 3 | blocks.SPREAD for k in rnd.choices(range(3), k=n)], np.int64))
    arrays = [pa.array([f"A-{i}" for i in range(n)]), pa.array([i % 2 == 0 for i in range(n)]), pa.array(who), *[pa.array(list(x), pa.int64()) for x in columns.values()], pa.array([False] * n)]
    block = blocks.Block(pa.RecordBatch.from_arrays(arrays, names=["record_id", "a", "who", *columns, "asks"]), key)
    found = lambda pairs: {tuple(r.values()) for i, j in pairs for r in blocks._compare(block, i, j, False, defaultdict(int)).to_pylist()}
    want = found(blocks.all_pairs(block.first, np.arange(n)))
    assert len(want) > 500 and {r[2][3] for r in want} >= set("ETMX")
    looked = {(*x,) for i, j in names.pairs_of(block) for x in zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())}
    assert found(names.pairs_of(block)) == found(matching.pairs_of(block)) == want and len(looked) < 0.5 * sum(m * (m - 1) // 2 for m in block.sizes.tolist())


def test_repeated_rows_make_no_value_busy(spark):
    a, b, g, truth = population(spark)
    again = a.where("cust_id = 'A-001'").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("k")
    p = people.marked(people.profiles(a.unionByName(again), b), 1000)[0].where("record_id = 'A-001'").collect()
    assert len(p) >= 100 and all(r["bits"] >> 2 * k & 3 == 0 for r in p for k in (0, 1, 3, 4))


def test_blank_and_single_names_in_a_batch(spark):
    a, b = [(f"A-{i}", x, *[None] * 8) for i, x in enumerate(("", " ", None, "X", "Zoe"))], [("B-1", "", None, *[None] * 8)]
    a, b, g = spark.createDataFrame(a, A_COLS), spark.createDataFrame(b, B_COLS), spark.createDataFrame([], G_COLS)
    assert match(a, b, g).count() == link_names(a, b, g).count() == 0


def test_words_are_counted_in_arrow_batches():
    import pyarrow as pa

    batch = lambda *x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["name"])
    one, none = people._count_words(iter([batch("Ann Lee", "LEE, Anne", "O'Neil Ltd", "Ann  de León"), batch("", "X")]))
    assert {r["word"]: (r["f"], r["l"], r["c"]) for r in one.to_pylist()} == {"ann": (2, 0, 0), "anne": (1, 0, 0), "lee": (0, 2, 0), "leon": (0, 1, 0), "o'neil": (0, 0, 1)}
    assert none.num_rows == 0 and none.schema == one.schema


def test_name_variants_are_linked(spark):
    a, b, g, truth = population(spark)
    name = {r["cust_id"]: r["full_name"] for r in a.collect()} | {r["client_ref"]: " ".join(x for x in (r["first_name"], r["last_name"]) if x) for r in b.collect()}
    want = {x for x in truth if name[x[0]] != name[x[1]]}
    got = {(r["id1"], r["id2"]) for r in link_names(a, b, g).collect()}
    assert len(got & want) >= 0.97 * len(want) and not got - want
    assert link_names(a.limit(0), b.limit(0), g.limit(0)).count() == 0


def test_usable_values(spark):
    v = ["a", "", " ", None, "N/A", "000 000 0000", "999999999999", "0", "x@x", "No  Fixed abode", "123"]
    df = spark.createDataFrame([(x,) for x in v], "v string")
    assert [r[0] for r in df.select(clean.usable(F.col("v"))).collect()] == [True, False, False, False, False, False, False, False, False, False, True]
    d = spark.createDataFrame([("31/02/1975",), ("1/2/1975",), ("1975-02-01",), ("01.02.1975",), ("x",), (None,)], "v string")
    assert [str(r[0]) for r in d.select(clean.date_of(F.col("v"))).collect()] == ["None", "1975-02-01", "1975-02-01", "1975-02-01", "None", "None"]


def _block(names):
    from tidemark.llm.people import NAME, arrow

    n, zero = len(names), [0] * len(names)
    rows = {"record_id": [f"A-{i}" for i in range(n)], "a": [True] * n, "who": [NAME.join(x) for x in names], "nm": list(range(n)), "bits": [1 << 4] * n, "key": [8] * n, "phone": [77] * n}
    batch = arrow({x.split()[0]: rows.get(x.split()[0], zero) for x in blocks.ROW.split(", ")}, blocks.ROW)
    return blocks.Block(batch, np.full(n, 8, np.int64))


def test_letters_of_names_leave_out_only_pairs_without_a_chance():
    from itertools import combinations

    from tidemark.llm.people import PRIOR, letters, name_code, named, NAME

    rng = np.random.default_rng(4)
    words = "ann anne joe muller mueller moller smith smyth simth tallow freight fright max maximilian bill william lee jurgen juergen o'neil garcia betty elizabeth haze joanne li weissenbach".split()
    pick = lambda most: " ".join(rng.choice(words, rng.integers(0, most + 1)))
    names = []
    for _ in range(220):
        given = str(rng.choice(["", *words]))
        names.append(("F", "", "", pick(4)) if rng.random() < 0.4 else ("P", given, given[:1] or str(rng.choice(["", "a", "b"])), pick(4)))
    block = _block(names)
    i, j = np.array(list(combinations(range(len(names)), 2))).T
    given, surname, unturned = block.apart(i, j)
    most = block.most(i, j, given & unturned, surname & unturned)
    firm = np.array([names[p][0] == "F" or names[q][0] == "F" for p, q in zip(i, j)])
    most[firm] = np.minimum(most[firm], block.firms_most(i[firm], j[firm]))
    says = [name_code(named(NAME.join(names[p])), named(NAME.join(names[q]))) for p, q in zip(i, j)]
    added = np.array([sum(PRIOR.get(k + x, 0.0) for k, x in zip("gsf", c)) for c in says])
    assert (added <= most + 1e-9).all() and (added < most).any()
    # letters and lengths of words are those of the texts
    for k, (_, first, _, rest) in enumerate(names):
        parts, at = rest.split(), block.who[k]
        for n, w in enumerate(parts[:3]):
            assert block.traits[9 + n][at] == letters(w) | (len(w) < 6) << 62
        assert block.further[at] == (len(parts) > 3) and [block.words[x] for x in block.numbers[:, at] if x >= 0] == [w for w in [first, *parts[:3]] if len(w) > 2]


def test_firms_and_persons_of_other_words_are_not_compared_word_by_word():
    names = [("F", "", "", "tallow freight"), ("P", "ann", "a", "lee"), ("F", "", "", "birch joinery"), ("F", "", "", "talow freight")]
    i, j, _, _ = _block(names).possible(np.array([0, 0, 0, 1]), np.array([1, 2, 3, 2]), False)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 3)]  # all four before


def test_words_that_names_share_are_found_for_all_pairs_at_once():
    from tidemark.llm.names import share_a_word, shared_word

    names = [("P", "ann", "a", "lee"), ("P", "anne", "a", "smith"), ("P", "", "j", "smyth"), ("F", "", "", "a b c smith"), ("P", "", "", ""), ("P", "li", "l", "li"), ("F", "", "", "weissenbach tallow")]
    block = _block(names)
    i, j = (x.ravel() for x in np.meshgrid(range(7), range(7)))
    assert shared_word(block, i, j).tolist() == [share_a_word(block.names[block.who[p]], block.names[block.who[q]]) for p, q in zip(i, j)]


def test_lines_that_differ_in_one_number_alone_are_parsed_once():
    address._around.cache_clear()
    rows = [address.parse_row(f"{n} Nuttall Avenue", "Lamthorpe", "LA80 6DT") for n in ("7", "0097", "54321", "0")]
    assert [r[0] for r in rows] == ["7", "97", "54321", "0"] and len({r[1:] for r in rows}) == 1
    assert address._around.cache_info().misses == 1
    assert address.parse_row("Flat 12 Nuttall Avenue", "Lamthorpe", None) == (None,) * 7
    assert address.parse_row("12 Nuttall Avenue LA80 6DT", None, None)[6] == "la806dt"
