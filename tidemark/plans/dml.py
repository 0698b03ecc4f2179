"""UPDATE, DELETE, INSERT, MERGE and TRUNCATE as queries that give the table's next state.

Parquet tables can't be changed in place; each statement becomes SELECT text over the temporary view of its target, so
Catalyst resolves its expressions and subqueries.  Clauses are cut out of the original text at keywords outside brackets
and quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.plans.retarget import Token, scan
from tidemark.store import StoreError


def _at(tokens: list[Token], words: tuple[str, ...], start: int = 0) -> int:
    """Index of the first run of keywords outside brackets; -1 if there is none."""
    for i in range(start, len(tokens) - len(words) + 1):
        if all(tokens[i + k].depth == 0 and tokens[i + k].upper == w for k, w in enumerate(words)):
            return i
    return -1


def _text(sql: str, tokens: list[Token], i: int, j: int) -> str:
    return sql[tokens[i].start : tokens[j - 1].end] if i < j else ""


def _split(sql: str, tokens: list[Token], i: int, j: int, depth: int = 0) -> list[tuple[int, int]]:
    """Token ranges between commas of a depth."""
    out, at = [], i
    for k in range(i, j):
        if tokens[k].text == "," and tokens[k].depth == depth:
            out.append((at, k))
            at = k + 1
    return [*out, (at, j)]


def _assignments(sql: str, tokens: list[Token], i: int, j: int) -> dict[str, str]:
    out = {}
    for a, b in _split(sql, tokens, i, j):
        eq = next(k for k in range(a, b) if tokens[k].text == "=" and tokens[k].depth == tokens[a].depth)
        out[tokens[eq - 1].text.strip('"`').upper()] = _text(sql, tokens, eq + 1, b)
    return out


def _alias(tokens: list[Token], i: int, stop: tuple[str, ...]) -> tuple[str, int]:
    """(name by which the table at token i is known, index after it)."""
    j = i + 1
    if j < len(tokens) and tokens[j].upper == "AS":
        j += 1
    if j < len(tokens) and tokens[j].kind == "word" and tokens[j].upper not in stop:
        return tokens[j].text, j + 1
    return tokens[i].text, i + 1


def next_state(spark: SparkSession, sql: str, kind: str, columns: list[str]) -> tuple[str, DataFrame]:
    """(view of the target, its rows after the statement) of a retargeted statement over temporary views."""
    tokens = scan(sql)
    listed = lambda alias: ", ".join(f"{alias}.`{c}`" for c in columns)
    by_upper = {c.upper(): c for c in columns}
    if kind == "TRUNCATE":
        view = tokens[2].text
        return view, spark.table(view).limit(0)
    if kind == "UPDATE":
        view = tokens[1].text
        alias, _ = _alias(tokens, 1, ("SET",))
        s, w = _at(tokens, ("SET",)), _at(tokens, ("WHERE",))
        sets = _assignments(sql, tokens, s + 1, w if w > 0 else len(tokens))
        if unknown := set(sets) - set(by_upper):
            raise StoreError("UNRESOLVED_COLUMN", ",".join(sorted(unknown)))
        types = dict(spark.table(view).dtypes)
        new = ", ".join(f"CAST(({sets[c.upper()]}) AS {types[c]}) AS `{c}`" if c.upper() in sets else f"{alias}.`{c}`" for c in columns)
        cond = _text(sql, tokens, w + 1, len(tokens)) if w > 0 else "true"
        return view, spark.sql(f"SELECT {new} FROM {view} {alias} WHERE {cond} UNION ALL SELECT {listed(alias)} FROM {view} {alias} WHERE NOT coalesce(({cond}), false)")
    if kind == "DELETE":
        view = tokens[2].text
        alias, _ = _alias(tokens, 2, ("WHERE",))
        w = _at(tokens, ("WHERE",))
        cond = _text(sql, tokens, w + 1, len(tokens)) if w > 0 else "true"
        return view, spark.sql(f"SELECT {listed(alias)} FROM {view} {alias} WHERE NOT coalesce(({cond}), false)")
    if kind == "INSERT":
        i = _at(tokens, ("INTO",)) + 1
        i += tokens[i].upper == "TABLE"
        view, j, into = tokens[i].text, i + 1, columns
        if tokens[j].text == "(" and tokens[j + 1].upper not in ("SELECT", "VALUES", "WITH"):
            end = next(k for k in range(j + 1, len(tokens)) if tokens[k].text == ")" and tokens[k].depth == 0)
            into = [by_upper.get(t.text.strip('"`').upper()) for t in tokens[j + 1 : end] if t.text != ","]
            if None in into:
                raise StoreError("UNRESOLVED_COLUMN", "insert list")
            j = end + 1
        rows = spark.sql(_text(sql, tokens, j, len(tokens)))
        if len(rows.columns) != len(into):
            raise StoreError("PARSE_ERROR", "the insert list and the rows differ in length")
        rows, types = rows.toDF(*into), dict(spark.table(view).dtypes)
        aligned = rows.select(*[(F.col(f"`{c}`") if c in into else F.lit(None)).cast(types[c]).alias(c) for c in columns])
        return view, spark.table(view).unionByName(aligned)
    if kind == "MERGE":
        return _merge(spark, sql, tokens, columns, by_upper)
    raise StoreError("UNSUPPORTED_STATEMENT", kind)


def _merge(spark: SparkSession, sql: str, tokens: list[Token], columns: list[str], by_upper: dict[str, str]) -> tuple[str, DataFrame]:
    i = _at(tokens, ("INTO",)) + 1
    view = tokens[i].text
    alias, j = _alias(tokens, i, ("USING",))
    u, o = _at(tokens, ("USING",)), _at(tokens, ("ON",))
    whens = [k for k in range(o, len(tokens)) if tokens[k].depth == 0 and tokens[k].upper == "WHEN"]
    source, cond = _text(sql, tokens, u + 1, o), _text(sql, tokens, o + 1, whens[0])
    types = dict(spark.table(view).dtypes)
    matched = deleted = inserted = None
    for n, k in enumerate(whens):
        end = whens[n + 1] if n + 1 < len(whens) else len(tokens)
        then = next(x for x in range(k, end) if tokens[x].depth == 0 and tokens[x].upper == "THEN")
        extra = next((x for x in range(k, then) if tokens[x].depth == 0 and tokens[x].upper == "AND"), None)
        test = _text(sql, tokens, extra + 1, then) if extra else "true"
        negative, verb = tokens[k + 1].upper == "NOT", tokens[then + 1].upper
        if not negative and verb == "UPDATE":
            matched = (test, _assignments(sql, tokens, then + 3, end))
        elif not negative and verb == "DELETE":
            deleted = test
        elif negative and verb == "INSERT":
            v = next(x for x in range(then, end) if tokens[x].upper == "VALUES")
            names = [by_upper.get(t.text.strip('"`').upper()) for t in tokens[then + 3 : v - 1] if t.text != ","] if tokens[then + 2].text == "(" else columns
            values = [_text(sql, tokens, a, b) for a, b in _split(sql, tokens, v + 2, end - 1, 1)]
            inserted = (test, dict(zip(names, values)))
        else:
            raise StoreError("UNSUPPORTED_STATEMENT", f"MERGE ... {verb}")
    # rows are numbered so that a target row met by two source rows can be told from two equal rows
    numbered = spark.table(view).withColumn("__row", F.monotonically_increasing_id())
    numbered.createOrReplaceTempView("merge_target")
    twice = spark.sql(f"SELECT 1 FROM merge_target {alias} JOIN {source} ON {cond} GROUP BY {alias}.__row HAVING count(*) > 1 LIMIT 1")
    if twice.count():
        raise StoreError("MERGE_AMBIGUOUS", "a target row meets more than one source row")
    listed = ", ".join(f"{alias}.`{c}`" for c in columns)
    parts = [f"SELECT {listed} FROM {view} {alias} LEFT ANTI JOIN {source} ON {cond}"]
    hit = f"FROM {view} {alias} JOIN {source} ON {cond}"
    gone = f"coalesce(({deleted}), false)" if deleted else "false"
    if matched:
        test, sets = matched
        new = ", ".join(f"CAST(CASE WHEN coalesce(({test}), false) THEN ({sets[c.upper()]}) ELSE {alias}.`{c}` END AS {types[c]}) AS `{c}`" if c.upper() in sets else f"{alias}.`{c}`" for c in columns)
        parts.append(f"SELECT {new} {hit} WHERE NOT {gone}")
    else:
        parts.append(f"SELECT {listed} {hit} WHERE NOT {gone}")
    if inserted:
        test, values = inserted
        new = ", ".join(f"CAST(({values.get(c, 'NULL')}) AS {types[c]}) AS `{c}`" for c in columns)
        parts.append(f"SELECT {new} FROM {source} LEFT ANTI JOIN {view} {alias} ON {cond} WHERE {test}")
    return view, spark.sql(" UNION ALL ".join(parts))
