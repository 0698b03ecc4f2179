"""Record linkage of two systems: normalise, block, score, three votes, verdict, groups, classes, published decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import scratch

#: Legal forms and generations at the end of a name, and the weights of the five signals.
BUSINESS = r" (LTD|LIMITED|PLC|INC|LLC|GMBH|BV|SL|CO)$"
SUFFIX = r" (JR|SR|JNR|SNR|II|III)$"
WEIGHTS = {"email": 30, "phone": 20, "name": 25, "addr": 15, "dob": 10}
THRESHOLD = 0.72
#: Letters with marks and what they are compared as.
MARKED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"


def blank_to_null(c: Column) -> Column:
    """The empty string is no value."""
    return F.nullif(c, F.lit(""))


def present(c: Column) -> Column:
    """The trimmed value; null for blanks, placeholders and numbers of one repeated digit."""
    v = F.trim(c)
    holder = F.lower(v).isin("-", "--", "---", ".", "?", "x", "n/a", "na", "n.a.", "none", "null", "nil", "unknown", "tbc", "tbd", "declined", "ex-directory")
    same = F.regexp_replace(v, r"[ ()+./-]", "").rlike(r"^(0{6,}|9{6,})$")
    return F.when((v != "") & ~holder & ~same, v)


def folded(c: Column) -> Column:
    """Without marks on letters, so that spellings with and without them are near."""
    return F.translate(F.replace(c, F.lit("ß"), F.lit("ss")), MARKED, PLAIN)


def normalise(df: DataFrame) -> DataFrame:
    """df(id, full_name, email, phone, addr_line, city, postcode, dob) -> the comparison columns; blanks are null."""
    name = F.upper(F.trim(F.regexp_replace(folded(F.col("full_name")), r"[^\p{L} ']", "")))
    out = df.select("*", blank_to_null(name).alias("name_n")).withColumn("name_base", blank_to_null(F.regexp_replace(F.regexp_replace("name_n", BUSINESS, ""), SUFFIX, "")))
    mail = F.lower(F.trim("email"))
    digits = F.regexp_replace(F.coalesce("phone", F.lit("")), r"[^0-9]", "")
    return out.select(
        "id", "name_n", "name_base",
        blank_to_null(F.regexp_extract("name_base", r"^([^ ]+)", 1)).alias("given_n"), blank_to_null(F.regexp_extract("name_base", r"([^ ]+)$", 1)).alias("family_n"),
        blank_to_null(F.regexp_extract("name_n", SUFFIX, 1)).alias("suffix"), F.when(F.col("name_n").rlike(BUSINESS), 1).otherwise(0).alias("is_business"),
        blank_to_null(mail).alias("email_n"), blank_to_null(F.regexp_extract(mail, r"^([^@]+)@", 1)).alias("email_local"), blank_to_null(F.regexp_extract(mail, r"@([^@]+)$", 1)).alias("email_domain"),
        blank_to_null(F.right(digits, F.lit(10))).alias("phone_n"), blank_to_null(F.right(digits, F.lit(7))).alias("phone7"),
        blank_to_null(F.upper(F.replace("postcode", F.lit(" "), F.lit("")))).alias("postcode_n"), blank_to_null(F.upper(F.regexp_replace(folded(F.col("addr_line")), r"[^\p{L}0-9]", ""))).alias("street_n"),
        blank_to_null(F.upper(F.trim(folded(F.col("city"))))).alias("city_n"), "dob",
    )


def block(a: DataFrame, b: DataFrame, keys: dict[str, tuple[Column, Column]], rule: str, within: bool = False) -> DataFrame:
    """(a_id, b_id, rule) of records that agree on every key expression; rows with a null key are dropped first.

    ``within`` pairs a table with itself, each pair once, smaller id first.
    """
    left = a.select(F.col("id").alias("a_id"), *[l.alias(k) for k, (l, _) in keys.items()]).dropna(subset=list(keys))
    right = b.select(F.col("id").alias("b_id"), *[r.alias(k) for k, (_, r) in keys.items()]).dropna(subset=list(keys))
    pairs = left.join(right, list(keys))
    pairs = pairs.where("a_id < b_id") if within else pairs
    return pairs.select("a_id", "b_id").distinct().withColumn("rule", F.lit(rule))


def standard_rules(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """The six blocking rules over two tables of comparison columns."""
    same = lambda *cs: {c: (F.col(c), F.col(c)) for c in cs}
    sn3, sx = F.substring("family_n", 1, 3), F.soundex("family_n")
    return {
        "EXACT_EMAIL": block(a, b, same("email_n"), "EXACT_EMAIL"),
        "PHONE7": block(a, b, same("phone7"), "PHONE7"),
        "POSTCODE_SN3": block(a, b, same("postcode_n") | {"sn3": (sn3, sn3)}, "POSTCODE_SN3"),
        "SOUNDEX_CITY": block(a, b, same("city_n") | {"sx": (sx, sx)}, "SOUNDEX_CITY"),
        "DOB_SOUNDEX": block(a, b, same("dob") | {"sx": (sx, sx)}, "DOB_SOUNDEX"),
        "SELF_EMAIL": block(a, a, same("email_n", "family_n", "postcode_n"), "SELF_EMAIL", within=True),
    }


def candidates(staged: list[DataFrame], kind: str) -> DataFrame:
    """(kind, a_id, b_id, block_rules): every pair once with its rules in order; AA pairs smaller id first."""
    pairs = reduce(DataFrame.unionByName, staged).where("a_id is not null and b_id is not null")
    if kind == "AA":
        pairs = pairs.where("a_id <> b_id").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "rule")
    rules = F.array_join(F.array_sort(F.collect_set("rule")), ",")
    return pairs.groupBy("a_id", "b_id").agg(rules.alias("block_rules")).withColumn("kind", F.lit(kind))


def signals(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with five per-mille signals (null where a side is missing; the address never is), the gap in years between
    the dates of birth and the flags of conflict."""
    tag = lambda df, t: df.select(*[F.col(c).alias(f"{t}_{c}") for c in df.columns])
    x = pairs.join(tag(a, "a"), "a_id").join(tag(b, "b"), "b_id")
    col = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    either = lambda c: F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull()
    eq = lambda c: F.col(f"a_{c}") == F.col(f"b_{c}")
    head = lambda c, n: F.substring(f"a_{c}", 1, n) == F.substring(f"b_{c}", 1, n)
    longest = F.greatest(F.length("a_name_base"), F.length("b_name_base"))
    spelling = F.floor(1000 - 1000 * F.levenshtein("a_name_base", "b_name_base") / longest)
    kin = F.when(F.coalesce(eq("family_n") & head("given_n", 1), F.lit(False)), 850).otherwise(0)
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n)
    return x.select(
        *pairs.columns,
        F.when(either("email_n"), None).when(eq("email_n"), 1000).when(eq("email_local"), 600).when(eq("email_domain"), 200).otherwise(0).alias("s_email"),
        F.when(either("phone_n"), None).when(eq("phone_n"), 1000).when(eq("phone7"), 700).otherwise(0).alias("s_phone"),
        F.when(either("name_base"), None).otherwise(F.greatest(spelling, kin)).cast("int").alias("s_name"),
        (yes(eq("postcode_n"), 500).otherwise(0) + yes(eq("street_n"), 500).otherwise(yes(head("street_n", 6), 300).otherwise(0))).alias("s_addr"),
        F.when(either("dob"), None).when(eq("dob"), 1000).otherwise(0).alias("s_dob"),
        F.abs(F.months_between("a_dob", "b_dob", False) / 12).alias("dob_gap"),
        yes(~col("suffix")[0].eqNullSafe(col("suffix")[1]), 1).otherwise(0).alias("f_suffix"),
        yes(F.col("a_is_business") != F.col("b_is_business"), 1).otherwise(0).alias("f_business"),
        yes(~head("given_n", 1), 1).otherwise(0).alias("f_given"),
        yes(eq("family_n"), 1).otherwise(0).alias("same_family"),
    )


def weighted_score(df: DataFrame) -> DataFrame:
    """score_total: the weighted mean of the signals that are there, to four places, halves up, in whole numbers."""
    there = [(F.col(f"s_{k}"), w) for k, w in WEIGHTS.items()]
    top = reduce(Column.__add__, [F.coalesce(s, F.lit(0)) * w for s, w in there])
    weight = reduce(Column.__add__, [F.when(s.isNotNull(), w).otherwise(0) for s, w in there])
    return df.withColumn("score_total", (F.floor((top * 20 + weight) / (weight * 2)) / 10000).cast("decimal(6,4)"))


def panel(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The votes of the exact, the weighing and the doubting reader, and what they come to."""
    strong = (F.col("s_dob") == 1000) | (F.col("s_email") == 1000) | (F.col("s_phone") >= 700) | (F.col("s_addr") >= 800)
    against = (F.col("s_dob") == 0) | (F.col("f_suffix") + F.col("f_business") + F.col("f_given") > 0)
    vote = lambda c: F.when(F.coalesce(c, F.lit(False)), "MERGE").otherwise("REJECT")
    out = df.withColumns({
        "vote_determ": vote((F.col("s_email") == 1000) | (F.col("s_phone") == 1000)),
        "vote_prob": vote(F.col("score_total") >= threshold),
        "vote_skeptic": vote(~F.coalesce(against, F.lit(False)) & (F.col("s_name") >= 800) & strong),
    })
    agree = (F.col("vote_determ") == F.col("vote_prob")) & (F.col("vote_prob") == F.col("vote_skeptic"))
    return out.withColumn("panel_result", F.when(agree, F.concat(F.lit("UNANIMOUS_"), F.col("vote_prob"))).otherwise("SPLIT"))


def summary(df: DataFrame) -> DataFrame:
    """comparison: what was compared and how near it is, in words that name nobody."""
    word = lambda c: F.when(F.col(c).isNull(), "missing").when(F.col(c) >= 950, "same").when(F.col(c) >= 600, "close").otherwise("different")
    gap = F.when(F.floor("dob_gap") > 0, F.concat(F.lit("born "), F.floor("dob_gap").cast("string"), F.lit(" years apart")))
    flags = [F.when(F.col(c) == 1, t) for c, t in (("f_suffix", "generation differs"), ("f_business", "person against firm"), ("f_given", "given initial differs"))]
    parts = [F.concat(F.lit(f"{k} "), word(f"s_{k}")) for k in WEIGHTS]
    return df.withColumn("comparison", F.concat_ws("; ", *parts, gap, *flags))


def verdicts(df: DataFrame, adjudicated: DataFrame | None = None) -> DataFrame:
    """verdict: MERGE where all vote so, or where the panel is split and adjudicated(a_id, b_id, decision) says SAME_PERSON.

    Without an adjudicator, or where it gives nothing, a split pair is left to people.
    """
    if adjudicated is None:
        df = df.withColumn("decision", F.lit(None).cast("string"))
    else:
        df = df.join(adjudicated.select("a_id", "b_id", "decision"), ["a_id", "b_id"], "left")
    said = F.when(F.col("panel_result") == "SPLIT", F.coalesce("decision", F.lit("INSUFFICIENT_EVIDENCE")))
    merge = (F.col("panel_result") == "UNANIMOUS_MERGE") | (said == "SAME_PERSON")
    return df.withColumn("decision", said).withColumn("verdict", F.when(F.coalesce(merge, F.lit(False)), "MERGE").otherwise("REJECT"))


def flag_clusters(df: DataFrame) -> DataFrame:
    """MERGE becomes FLAG in groups of more than two records: exactly the links one of whose ends has two or more."""
    df = named_nodes(scratch(df.sparkSession).table(df, "decided"))  # written once: both the degrees and the pairs read it
    merged = df.where("verdict = 'MERGE'")
    ends = merged.select(F.explode(F.array("x", "y")).alias("node"), F.struct(F.least("x", "y"), F.greatest("x", "y")).alias("edge")).distinct()
    many = ends.groupBy("node").count().where("count >= 2").select("node", F.lit(True).alias("many"))
    out = df.join(many.toDF("x", "mx"), "x", "left").join(many.toDF("y", "my"), "y", "left")
    return out.withColumn("verdict", F.when((F.col("verdict") == "MERGE") & (F.coalesce("mx", F.lit(False)) | F.coalesce("my", F.lit(False))), "FLAG").otherwise(F.col("verdict"))).drop("x", "y", "mx", "my")


def named_nodes(pairs: DataFrame) -> DataFrame:
    """pairs with x and y, their ends as nodes: an id of A and the same id of B are two records."""
    side = F.lit("B:") if "kind" not in pairs.columns else F.when(F.col("kind") == "AA", "A:").otherwise("B:")
    return pairs.withColumn("x", F.concat(F.lit("A:"), "a_id")).withColumn("y", F.concat(side, "b_id"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component, size) of the ends of pairs(x, y): the least node that is reachable, and how many are.

    Large and small stars take turns: every node hands its larger neighbours to its least one, then its smaller ones,
    until all edges lead to the least node of their group.  Each round is written to the shared folder; only whether
    anything changed reaches the driver.
    """
    area = scratch(pairs.sparkSession)
    edges = area.table(pairs.where("x is not null and y is not null and x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = area.table(small, "edges")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        area.drop(edges)
        edges = after
        if mark == seen:
            break
        seen = mark
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return nodes.join(nodes.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", "component", "size")


def match_class(df: DataFrame) -> DataFrame:
    """match_class of merged pairs: within a system, then by e-mail, by phone and postcode, else by name."""
    c = F.when(F.col("kind") == "AA", "INTERNAL_DEDUP").when(F.col("s_email") == 1000, "EXACT_EMAIL")
    c = c.when((F.col("s_phone") == 1000) & (F.col("s_addr") >= 500), "PHONE_ADDRESS").otherwise("FUZZY_NAME")
    return df.withColumn("match_class", F.when(F.col("verdict") == "MERGE", c))


def new_records(b: DataFrame, decided: DataFrame) -> DataFrame:
    """Ids of B in no merged and no flagged pair."""
    return b.select(F.col("id").alias("b_id")).join(decided.where("verdict in ('MERGE', 'FLAG')").select("b_id").distinct(), "b_id", "left_anti")


def default_approvals(diff: DataFrame, expected: DataFrame, split: DataFrame) -> DataFrame:
    """Rows nobody decided: not approved where the key was not expected, or stems from a pair the panel was split on."""
    known, torn = expected.select("key_value", F.lit(True).alias("known")).distinct(), split.select("key_value", F.lit(True).alias("torn")).distinct()
    out = diff.join(known, "key_value", "left").join(torn, "key_value", "left")
    open_ = F.col("default_reason") == "DEFAULT"
    reason = F.when(open_ & F.col("known").isNull(), "UNEXPLAINED").when(open_ & F.col("torn"), "PANEL_SPLIT").otherwise(F.col("default_reason"))
    out = out.withColumn("default_reason", reason)
    return out.withColumn("approved", F.when(F.col("default_reason").isin("UNEXPLAINED", "PANEL_SPLIT"), F.lit(False)).otherwise(F.col("approved"))).drop("known", "torn")


def survive(golden: DataFrame, matches: DataFrame, now: Column) -> DataFrame:
    """Golden rows with their match's values merged in, and a note of where each came from.

    matches(golden_id, b_id, b_email, b_phone, b_addr_line, b_city, b_postcode, b_dob, b_last_seen, a_created_at): missing
    contact values and dates are filled from B; the address follows B where B was seen later than A was made.
    """
    x = golden.join(matches, "golden_id", "left")
    hit, newer = F.col("b_id").isNotNull(), F.col("b_last_seen") > F.col("a_created_at")
    take = lambda c, o: F.when(hit & F.col(c).isNull(), F.col(o)).otherwise(F.col(c))
    moved = lambda c, o: F.when(hit & newer, F.col(o)).otherwise(F.col(c))
    note = F.to_json(F.struct(
        F.lit("A").alias("FULL_NAME"), F.when(F.col("email").isNull(), "B").otherwise("A").alias("EMAIL"), F.when(F.col("phone").isNull(), "B").otherwise("A").alias("PHONE"),
        F.when(newer, "B_newer").otherwise("A").alias("ADDRESS"), F.when(F.col("date_of_birth").isNull(), "B").otherwise("A").alias("DATE_OF_BIRTH"),
    ))
    values = {
        "email": take("email", "b_email"), "phone": take("phone", "b_phone"), "date_of_birth": take("date_of_birth", "b_dob"), "addr_line": moved("addr_line", "b_addr_line"),
        "city": moved("city", "b_city"), "postcode": moved("postcode", "b_postcode"), "source_b_ref": F.when(hit, F.col("b_id")).otherwise(F.col("source_b_ref")),
        "merged_at": F.when(hit, now).otherwise(F.col("merged_at")), "survivorship": F.when(hit, note).otherwise(F.col("survivorship")),
    }
    return x.select(*[values.get(c, F.col(c)).alias(c) for c in golden.columns])


def publish(decided: DataFrame, a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """The decision tables: matches (golden_id, a_id, b_id, match_class, panel_result), new_customers (new_golden_id,
    b_id) and dedup (keep_golden_id, drop_golden_id, a_id, a_dup_id, panel_result)."""
    golden = lambda c: F.concat(F.lit("G-"), c)
    merged = decided.where("verdict = 'MERGE'")
    across, within = merged.where("kind = 'AB'"), merged.where("kind = 'AA'")
    return {
        "matches": across.join(a.select(F.col("id").alias("a_id")).distinct(), "a_id", "left_semi").select(golden("a_id").alias("golden_id"), "a_id", "b_id", "match_class", "panel_result"),
        "new_customers": new_records(b, decided.where("kind = 'AB'")).select(golden("b_id").alias("new_golden_id"), "b_id").distinct(),
        "dedup": within.select(golden("a_id").alias("keep_golden_id"), golden("b_id").alias("drop_golden_id"), "a_id", F.col("b_id").alias("a_dup_id"), "panel_result"),
    }


#: The classes of a matching run, in the order in which they are applied.
CLASSES = ("EXACT_EMAIL", "PHONE_ADDRESS", "NEW_CUSTOMERS", "INTERNAL_DEDUP", "FUZZY_NAME")


def expected_keys(published: dict[str, DataFrame], cls: str, split_only: bool = False) -> DataFrame:
    """(key_value): the golden keys that a class may touch; with ``split_only`` those of pairs the panel was split on."""
    if cls == "NEW_CUSTOMERS":
        keys = published["new_customers"].select(F.col("new_golden_id").alias("key_value"))
        return keys.limit(0) if split_only else keys
    rows = published["dedup"] if cls == "INTERNAL_DEDUP" else published["matches"].where(F.col("match_class") == cls)
    rows = rows.where("panel_result = 'SPLIT'") if split_only else rows
    named = ("keep_golden_id", "drop_golden_id") if cls == "INTERNAL_DEDUP" else ("golden_id",)
    return rows.select(F.explode(F.array(*named)).alias("key_value"))


def insert_new(golden: DataFrame, new: DataFrame, values: DataFrame, now: Column) -> DataFrame:
    """Golden rows and those of new customers, new(new_golden_id, b_id), with the fields of values(b_id, ...)."""
    own = {"golden_id": F.col("new_golden_id"), "source_b_ref": F.col("b_id"), "merged_at": now, "survivorship": F.lit('{"ALL":"B"}')}
    x = new.join(values, "b_id")
    fields = [own.get(c, F.col(c) if c in values.columns else F.lit(None)).cast(golden.schema[c].dataType).alias(c) for c in golden.columns]
    return golden.unionByName(x.select(*fields))


def absorb(golden: DataFrame, dedup: DataFrame, now: Column) -> DataFrame:
    """Golden rows after duplicates within A: the kept row names the records it absorbed, the dropped rows are gone.

    A row that is itself dropped absorbs nobody; several duplicates of a row are named in order.
    """
    dropped = dedup.select(F.col("drop_golden_id").alias("golden_id")).distinct()
    taken = dedup.groupBy(F.col("keep_golden_id").alias("golden_id")).agg(F.array_join(F.array_sort(F.collect_set("a_dup_id")), ",").alias("__refs"))
    x = golden.join(dropped, "golden_id", "left_anti").join(taken, "golden_id", "left")
    hit = F.col("__refs").isNotNull()
    values = {"merged_a_refs": F.when(hit, F.col("__refs")).otherwise(F.col("merged_a_refs")), "merged_at": F.when(hit, now).otherwise(F.col("merged_at"))}
    return x.select(*[values.get(c, F.col(c)).alias(c) for c in golden.columns])


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(proposed, correct, true_pairs, precision, recall, f1) of found(a_id, b_id) against truth(a_id, b_id), pairs either way round."""
    canon = lambda df: df.select(F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y")).distinct()
    f, t = canon(found).withColumn("f", F.lit(1)), canon(truth).withColumn("t", F.lit(1))
    n = f.join(t, ["x", "y"], "full_outer").agg(F.count("f").alias("proposed"), F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("correct"), F.count("t").alias("true_pairs"))
    n = n.withColumn("precision", F.try_divide("correct", "proposed")).withColumn("recall", F.try_divide("correct", "true_pairs"))
    return n.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only table."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")
