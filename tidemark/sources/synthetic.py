"""Two synthetic customer systems with a known answer, made from hashes of row numbers: any size, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GIVEN = ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gus", "Hope", "Ivy", "Jon", "Kim", "Leo")
FAMILY = ("Ashdown", "Birch", "Carver", "Dale", "Elm", "Frost", "Grove", "Heath", "Ives", "Jarvis", "Knox", "Lowe")
STREETS = ("High Street", "Mill Lane", "Station Road", "Park Avenue", "Church Street")


def _pick(words: tuple[str, ...], h: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(h, F.lit(len(words))) + 1).cast("int"))


def customers(spark: SparkSession, n: int, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, truth): n entities; seven in ten stand in both systems, two in A only, one in B only.

    B's copies have initials for given names (one in three), typed surnames (one in twenty), other addresses (one in
    seven) and missing dates of birth (one in twelve); ``truth`` holds the (a_id, b_id) of the common ones.
    """
    h = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "id")
    e = spark.range(n).withColumn("part", F.pmod(h("part"), F.lit(10)))
    e = e.select(
        "id", "part", _pick(GIVEN, h("g")).alias("given"), _pick(FAMILY, h("f")).alias("family"), F.concat(F.pmod(h("no"), F.lit(200)) + 1, F.lit(" "), _pick(STREETS, h("s"))).alias("street"),
        F.date_add(F.lit("1940-01-01").cast("date"), F.pmod(h("d"), F.lit(22000)).cast("int")).alias("dob"), F.lpad(F.pmod(h("p"), F.lit(10**10)).cast("string"), 10, "0").alias("phone"), F.format_string("c%d@mail.example", "id").alias("email"),
    )
    key = lambda p: F.format_string(p + "-%09d", "id")
    chance = lambda salt, k: F.pmod(h(salt), F.lit(k)) == 0
    a = e.where("part < 9").select(key("A").alias("cust_id"), F.concat_ws(" ", "given", "family").alias("full_name"), "email", "phone", F.col("street").alias("addr_line"), F.col("dob").alias("date_of_birth"))
    given = F.when(chance("i", 3), F.concat(F.substring("given", 1, 1), F.lit("."))).otherwise(F.col("given"))
    family = F.when(chance("t", 20), F.concat(F.col("family"), F.substring("family", -1, 1))).otherwise(F.col("family"))
    moved = F.when(chance("m", 7), F.concat(F.lit("1 "), _pick(STREETS, h("n")))).otherwise(F.col("street"))
    b = e.where("part < 7 or part = 9").select(key("B").alias("client_ref"), given.alias("first_name"), family.alias("last_name"), F.col("email").alias("email_addr"), F.col("phone").alias("mobile"), moved.alias("street"), F.when(~chance("b", 12), F.date_format("dob", "dd/MM/yyyy")).alias("dob"))
    truth = e.where("part < 7").select(key("A").alias("a_id"), key("B").alias("b_id"))
    return a, b, truth


#: Short forms that the second system may hold.
NICKNAMES = {"Ben": "Benny", "Dan": "Danny", "Jon": "Jonny", "Kim": "Kimmy", "Leo": "Lee"}


def dataset(spark: SparkSession, n: int, seed: int = 7) -> dict[str, DataFrame]:
    """``customers`` with what makes matching hard, and its answer key.

    a, b: the two systems; one entity in forty of A stands there twice (true_dups), one in twenty-five of B has a decoy
    in B, a relative of the same surname, address and phone with another given name and date of birth.  Given names of B
    may be short forms.  true_pairs(a_id, b_id, is_match, is_decoy).
    """
    a, b, truth = customers(spark, n, seed)
    number = lambda c: F.substring(c, 3, 9).cast("long")
    h = lambda salt, c: F.xxhash64(F.lit(seed), F.lit(salt), number(c))
    again = a.where(F.pmod(h("dup", "cust_id"), F.lit(40)) == 0)
    twice = again.withColumn("cust_id", F.format_string("A-%09d", number("cust_id") + 500_000_000)).withColumn("full_name", F.upper("full_name")).withColumn("email", F.lit(None).cast("string"))
    short = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv]), F.col("first_name")), F.col("first_name"))
    b = b.withColumn("first_name", F.when(F.pmod(h("nick", "client_ref"), F.lit(4)) == 0, short).otherwise(F.col("first_name")))
    kin = b.where(F.pmod(h("decoy", "client_ref"), F.lit(25)) == 0)
    other = kin.withColumn("client_ref", F.format_string("B-%09d", number("client_ref") + 500_000_000)).withColumn("first_name", F.lit("Quentin")).withColumn("email_addr", F.lit(None).cast("string")).withColumn("dob", F.lit("05/05/2001"))
    decoys = kin.select(F.format_string("A-%09d", number("client_ref")).alias("a_id"), F.format_string("B-%09d", number("client_ref") + 500_000_000).alias("b_id"))
    decoys = decoys.join(a.select(F.col("cust_id").alias("a_id")), "a_id", "left_semi")
    pairs = truth.select("a_id", "b_id", F.lit(True).alias("is_match"), F.lit(False).alias("is_decoy")).unionByName(decoys.select("a_id", "b_id", F.lit(False).alias("is_match"), F.lit(True).alias("is_decoy")))
    dups = again.select(F.col("cust_id").alias("a_id"), F.format_string("A-%09d", number("cust_id") + 500_000_000).alias("a_dup_id"))
    return {"a": a.unionByName(twice), "b": b.unionByName(other), "true_pairs": pairs, "true_dups": dups}
