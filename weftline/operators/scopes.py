"""Query scopes: columns of nested queries, WITH and sub-selects traced to the tables they come from.

A statement's nested queries are numbered by a fold over its parentheses; each becomes a row (a
scope) with its parent, and the text around it keeps ``#Qn`` in its place. FROM lists of a scope give
its aliases, which nested scopes see too (correlation), the nearest first; names of WITH queries stand
for their scopes. Stars over queries, and over tables whose columns are declared, are written out from
the inside. Columns are then followed from the statement's targets inwards by iterated joins on
(statement, scope, column): a round joins only what the last one reached and stops when nothing is
left, so it takes as many rounds as queries are nested; a query that reads itself ends where it was
reached before.

A name that no scope explains is a gap of its statement with the reason, never a table.

Statements: INSERT … SELECT and … WITH, CREATE TABLE … AS, views, UPDATE (also of several columns from
one query) and MERGE with its UPDATE and INSERT parts. Their key is path, program and seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.functions import scalars as S
from weftline.operators.lineage import CLAUSES, DATA_VERBS, SETS, SQL_WORDS
from weftline.session import settled

KEY = ["path", "program", "seq"]
#: The private character that stands for a parenthesis that opens a query.
OPEN = "\ue010"
#: The targets of statements with a query, and words between the tables of a FROM list.
TARGET = r"^(?:INSERT INTO|CREATE (?:OR REPLACE )?(?:(?:NO )?FORCE )?(?:EDITIONABLE )?(?:MATERIALIZED )?VIEW|CREATE (?:GLOBAL TEMPORARY )?TABLE) ([A-Z0-9_.$#]+)"
JOINS = "LEFT OUTER JOIN|LEFT JOIN|RIGHT OUTER JOIN|RIGHT JOIN|FULL OUTER JOIN|FULL JOIN|INNER JOIN|CROSS JOIN|NATURAL JOIN|JOIN"
UPDATE = r"^UPDATE ([A-Z0-9_.$#]+)(?: (?:AS )?(?!SET\b)([A-Z0-9_$]+))? SET (.*)$"
MERGE = r"^MERGE INTO ([A-Z0-9_.$#]+)(?: (?:AS )?(?!USING\b)([A-Z0-9_$]+))? USING ([#A-Z0-9_.$]+)(?: (?:AS )?(?!ON\b)([A-Z0-9_$]+))? ON (.*)$"
WITH = r"\bWITH (?:RECURSIVE )?((?:[A-Z][A-Z0-9_$]*(?: ?\([^()]*\))? AS #Q\d+ ?,? ?)+)"


def scopes(stmts: DataFrame) -> DataFrame:
    """KEY, scope, parent, text: a statement (scope 0) and each query nested in it, numbered in order of their parentheses."""
    text = F.regexp_replace(F.regexp_replace("stmt", r'"([^"]*+)"', "$1"), r"\( ?(?=(?:SELECT|WITH)\b)", OPEN)
    tokens = F.regexp_extract_all(text, F.lit(rf"([(){OPEN}]|[^(){OPEN}]++)"), F.lit(1))
    part = lambda scope, parent, depth, text: F.struct(scope.alias("scope"), parent.alias("parent"), depth.alias("depth"), text.alias("text"))
    root = part(F.lit(0), F.lit(-1), F.lit(0), F.lit(""))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.array(root).alias("open"), F.slice(F.array(root), 1, 0).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        depth, n, held, done = acc["depth"], acc["n"], acc["open"], acc["done"]
        top, below = F.element_at(held, -1), F.slice(held, 1, F.size(held) - 1)
        longer = lambda more: F.concat(below, F.array(part(top["scope"], top["parent"], top["depth"], F.concat(top["text"], more))))
        begins, ends = x == OPEN, (x == ")") & (F.size(held) > 1) & (top["depth"] == depth)
        inner = F.concat(longer(F.concat(F.lit(" #Q"), (n + 1).cast("string"), F.lit(" "))), F.array(part(n + 1, top["scope"], depth + 1, F.lit(""))))
        return F.struct(
            (depth + x.isin("(", OPEN).cast("int") - (x == ")").cast("int")).alias("depth"),
            (n + begins.cast("int")).alias("n"),
            F.when(begins, inner).when(ends, below).otherwise(longer(x)).alias("open"),
            F.when(ends, F.concat(done, F.array(top))).otherwise(done).alias("done"),
        )

    folded = F.aggregate(tokens, zero, step)
    each = stmts.select(*KEY, folded.alias("f")).select(*KEY, F.explode(F.concat("f.done", "f.open")).alias("s"))
    return each.select(*KEY, "s.scope", "s.parent", F.trim(F.regexp_replace("s.text", r"\s+", " ")).alias("text"))


def _named(text: Column) -> Column:
    """(alias, table) of each table or query of a FROM list; a name is an alias of itself."""
    parts = F.flatten(F.transform(S.clauses(text, JOINS), lambda p: S.split_top(p["text"])))
    parts = F.transform(parts, lambda x: F.regexp_replace(x, r"^(?:LATERAL|ONLY) ", ""))
    name = lambda x: F.regexp_extract(x, r"^([#A-Z0-9_.$]+)", 1)
    alias = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^[#A-Z0-9_.$]+ (?:AS )?(?!(?:ON|USING|WHERE)\b)([A-Z0-9_$]+)", 1), F.lit("")), name(x))
    return F.filter(F.transform(parts, lambda x: F.struct(alias(x).alias("alias"), name(x).alias("table"))), lambda p: p["table"] != "")


def _clause(parts: Column, key: str) -> Column:
    return F.get(F.transform(F.filter(parts, lambda p: p["key"] == key), lambda p: p["text"]), F.lit(0))


def with_queries(scoped: DataFrame) -> DataFrame:
    """KEY, scope (where the WITH stands), name, names (stated columns), query (its scope)."""
    each = scoped.select(*KEY, "scope", F.explode(F.regexp_extract_all(F.regexp_extract("text", WITH, 1), F.lit(r"([A-Z][A-Z0-9_$]*(?: ?\([^()]*\))? AS #Q\d+)"), F.lit(1))).alias("x"))
    return each.select(*KEY, "scope", F.regexp_extract("x", r"^([A-Z0-9_$]+)", 1).alias("name"), S.split_top(F.regexp_extract("x", r"\(([^()]*)\)", 1)).alias("names"), F.regexp_extract("x", r"#Q(\d+)$", 1).cast("int").alias("query"))


def _own_name(item: Column) -> tuple[Column, Column]:
    """The name that an item of a select list has of its own ('' if none), and its expression."""
    # without AS, only after what can end an expression
    alias = F.regexp_extract(item, r"(?: AS |(?<=[A-Z0-9_$#)'])(?<!\b(?:AND|OR|NOT|LIKE|IN|IS|BETWEEN|THEN|ELSE|WHEN|CASE|DISTINCT|DATE|MOD|DIV)) )([A-Z_][A-Z0-9_$#]*)$", 1)
    alias = F.when(alias.isin("END", "NULL"), "").otherwise(alias)
    expr = F.when(alias != "", F.regexp_replace(item, r"(?: AS)? [A-Z_][A-Z0-9_$#]*$", "")).otherwise(item)
    return F.coalesce(F.nullif(alias, F.lit("")), F.regexp_extract(item, r"^(?:[A-Z0-9_$#.]+\.)?([A-Z0-9_$#]+)$", 1)), expr


def query_items(scoped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Select lists and FROM lists of all queries.

    items: KEY, scope, branch (of a UNION), pos, own, expr, names (stated by INSERT or view), target, filter;
    frames: KEY, scope, branch, alias, table.
    """
    moving = (F.col("scope") > 0) | F.col("text").rlike(TARGET)
    head = F.regexp_replace("text", TARGET, "")
    names = F.when(F.col("scope") == 0, S.split_top(F.regexp_extract(head, r"^ ?\(([^()]*)\)", 1))).otherwise(F.array().cast("array<string>"))
    query = F.when(F.col("scope") == 0, F.regexp_replace(head, r"^ ?(?:\([^()]*\))? ?(?:AS )?", "")).otherwise(F.col("text"))
    # what stands between a table's name and its query (storage, options) is passed over
    query = F.regexp_replace(F.regexp_replace(query, WITH, ""), r"^(?:(?!\bSELECT\b|#Q).)*+(?=\bSELECT\b|#Q)", "")
    branches = F.filter(S.clauses(query, SETS), lambda p: p["text"] != "")
    each = scoped.where(moving).select(*KEY, "scope", F.when(F.col("scope") == 0, F.regexp_extract("text", TARGET, 1)).alias("target"), names.alias("names"), F.posexplode(branches).alias("branch", "q"))
    alone = F.regexp_extract("q.text", r"^(#Q\d+)$", 1)
    each = each.withColumn("parts", S.once(S.clauses(F.when(alone != "", F.concat(F.lit("SELECT * FROM "), alone)).otherwise(F.col("q.text")), CLAUSES)))
    each = each.withColumns({"select": F.regexp_replace(_clause("parts", "SELECT"), r"^(?:DISTINCT|ALL|UNIQUE) ", ""), "from": F.coalesce(_clause("parts", "FROM"), F.lit("")), "filter": _clause("parts", "WHERE")}).where("select is not null")
    own, expr = _own_name(F.col("item"))
    items = each.select(*KEY, "scope", "branch", "target", "names", "filter", F.posexplode(S.split_top(F.col("select"))).alias("pos", "item")).select(*KEY, "scope", "branch", "target", "names", "filter", "pos", own.alias("own"), expr.alias("expr"))
    frames = each.select(*KEY, "scope", "branch", F.explode(_named(F.col("from"))).alias("x")).select(*KEY, "scope", "branch", "x.alias", "x.table")
    return items, frames


def assignment_items(scoped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for UPDATE and MERGE: each assigned column is an item of scope 0; of several from one query, ``nth`` is its place there."""
    root = scoped.where("scope = 0")
    g = lambda pattern, k: F.regexp_extract("text", pattern, k)
    up = root.where(F.col("text").rlike(UPDATE)).select(*KEY, g(UPDATE, 1).alias("target"), g(UPDATE, 2).alias("alias"), F.lit("").alias("using"), F.lit("").alias("using_alias"), S.clauses(F.concat(F.lit("SET "), g(UPDATE, 3)), "SET|WHERE|RETURNING").alias("parts"))
    merge = root.where(F.col("text").rlike(MERGE)).select(*KEY, g(MERGE, 1).alias("target"), g(MERGE, 2).alias("alias"), g(MERGE, 3).alias("using"), g(MERGE, 4).alias("using_alias"), S.clauses(g(MERGE, 5), "UPDATE SET|INSERT|VALUES|WHERE|WHEN MATCHED|WHEN NOT MATCHED|DELETE WHERE").alias("parts"))
    both = up.unionByName(merge)
    sets = F.flatten(F.transform(F.filter("parts", lambda p: p["key"].isin("SET", "UPDATE SET")), lambda p: S.split_top(p["text"])))
    each = both.select(*KEY, "target", F.posexplode(sets).alias("at", "item"), _clause("parts", "WHERE").alias("filter"))
    left, expr = F.trim(F.regexp_extract("item", r"^([^=]*)=", 1)), F.trim(F.regexp_replace("item", r"^[^=]*= ?", ""))
    columns = F.when(left.startswith("("), S.split_top(F.regexp_replace(left, r"^\((.*)\)$", "$1"))).otherwise(F.array(left))
    each = each.select(*KEY, "target", "filter", "at", F.size(columns).alias("many"), F.posexplode(columns).alias("nth", "column"), expr.alias("expr"))
    bare = F.regexp_extract("column", r"([A-Z0-9_$#]+)$", 1)
    assigned = each.select(*KEY, "target", "filter", F.struct("at", "nth").alias("order"), bare.alias("own"), "expr", F.when(F.col("many") > 1, F.col("nth")).otherwise(0).alias("nth"))
    lists = lambda key: S.split_top(F.regexp_replace(F.coalesce(_clause("parts", key), F.lit("")), r"^\((.*)\).*$", "$1"))
    put = both.select(*KEY, "target", F.lit(None).cast("string").alias("filter"), F.posexplode(F.arrays_zip(lists("INSERT").alias("column"), lists("VALUES").alias("expr"))).alias("at", "z"))
    put = put.select(*KEY, "target", "filter", F.struct((F.col("at") + 100_000).alias("at"), F.lit(0).alias("nth")).alias("order"), F.regexp_extract("z.column", r"([A-Z0-9_$#]+)$", 1).alias("own"), F.col("z.expr").alias("expr"), F.lit(0).alias("nth")).where("own is not null and expr is not null")
    items = assigned.unionByName(put).withColumn("pos", F.row_number().over(W.Window.partitionBy(*KEY).orderBy("order")) - 1)
    items = items.select(*KEY, F.lit(0).alias("scope"), F.lit(0).alias("branch"), "target", F.array().cast("array<string>").alias("names"), "filter", "pos", "own", "expr", "nth")
    pair = lambda alias, name: F.struct(F.coalesce(F.nullif(F.col(alias), F.lit("")), F.col(name)).alias("alias"), F.col(name).alias("table"))
    frames = both.select(*KEY, F.explode(F.filter(F.array(pair("alias", "target"), pair("using_alias", "using")), lambda p: p["table"] != "")).alias("x"))
    return items, frames.select(*KEY, F.lit(0).alias("scope"), F.lit(0).alias("branch"), "x.alias", "x.table")


def ancestors(scoped: DataFrame) -> DataFrame:
    """KEY, scope, above, dist: each scope with itself and all scopes around it; a round for each level."""
    parents = scoped.select(*KEY, "scope", "parent")
    level = settled(parents.select(*KEY, "scope", F.col("scope").alias("above"), F.lit(0).alias("dist")))
    out = level
    step = parents.select(*KEY, F.col("scope").alias("above"), "parent").where("parent >= 0")
    while not level.isEmpty():
        level = settled(level.join(step, [*KEY, "above"]).select(*KEY, "scope", F.col("parent").alias("above"), (F.col("dist") + 1).alias("dist")))
        out = out.unionByName(level)
    return out


def _query(table: Column) -> Column:
    """The scope that ``#Qn`` names, null for a table."""
    return F.nullif(F.regexp_extract(table, r"^#Q(\d+)$", 1), F.lit("")).cast("int")


def expanded(items: DataFrame, frames: DataFrame, stated: DataFrame, declared: DataFrame) -> DataFrame:
    """Items with stars written out where their tables' columns are known, inner queries first; other stars stay.

    stated: KEY, scope, pos, name of columns named outside a query's select list. Items get ``name``, what a
    query's column is called by those around it.
    """
    order = W.Window.partitionBy(*KEY, "scope", "branch").orderBy("order")
    named = stated.select(*KEY, "scope", "pos", F.col("name").alias("stated"))
    star = F.col("expr").rlike(r"^(?:[A-Z0-9_$#.]+\.)?\*$")
    known = declared.select(F.col("table").alias("of"), F.col("pos").alias("inner"), F.col("column").alias("found"))
    while True:
        items = settled(items)
        stars = items.where(star).withColumn("alias", F.nullif(F.regexp_extract("expr", r"^(.*)\.\*$", 1), F.lit("")))
        if stars.isEmpty():
            return items
        tables = frames.select(*KEY, "scope", "branch", F.col("alias").alias("a"), F.col("table").alias("of"))
        met = stars.join(tables, [*KEY, "scope", "branch"]).where("alias is null or alias = a")
        names = items.withColumn("open", star).withColumn("any", F.max("open").over(W.Window.partitionBy(*KEY, "scope"))).where("not any and branch = 0")
        inner = names.join(named, [*KEY, "scope", "pos"], "left").select(*KEY, F.concat(F.lit("#Q"), F.col("scope").cast("string")).alias("of"), F.col("pos").alias("inner"), F.coalesce("stated", "own").alias("found"))
        written = met.join(inner, [*KEY, "of"]).unionByName(met.join(known, "of"), allowMissingColumns=True)
        # only stars all of whose tables are known
        need = met.groupBy(*KEY, "scope", "branch", "pos").agg(F.count_distinct("a").alias("tables"))
        have = written.groupBy(*KEY, "scope", "branch", "pos").agg(F.count_distinct("a").alias("known"))
        ready = need.join(have, [*KEY, "scope", "branch", "pos"]).where("tables = known").select(*KEY, "scope", "branch", "pos")
        ready = settled(ready)
        if ready.isEmpty():
            return items
        at = [*KEY, "scope", "branch", "pos"]
        new = written.join(ready, at, "left_semi").withColumns({"order": F.struct("pos", "a", "inner"), "own": F.col("found"), "expr": F.concat("a", F.lit("."), "found")})
        kept = items.join(ready, at, "left_anti").withColumn("order", F.struct("pos", F.lit("").alias("a"), F.lit(0).alias("inner")))
        items = kept.unionByName(new.select(*kept.columns)).withColumn("pos", F.row_number().over(order) - 1).drop("order")


def references(items: DataFrame) -> DataFrame:
    """What each item's expression names: KEY, scope, branch, pos, qualifier, column, query, nth."""
    text = F.regexp_replace(S.without_literals(F.col("expr")), r" AS [A-Z][A-Z0-9]*(?: ?\([^()]*+\))? ?\)", ")")
    dotted = F.regexp_extract_all(text, F.lit(r"(?<![A-Z0-9_$#.:])((?:[A-Z]|#Q\d)[A-Z0-9_$#]*(?:\.[A-Z0-9_$#]+)+)(?! ?\(|[A-Z0-9_$#.])"), F.lit(1))
    queries = F.regexp_extract_all(text, F.lit(r"#Q(\d++)(?!\.)"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"(?<![A-Z0-9_$#.:])([A-Z_][A-Z0-9_$#]*)(?! ?\(|[A-Z0-9_$#.])"), F.lit(1))
    bare = F.filter(bare, lambda x: ~x.rlike(f"^(?:{'|'.join(SQL_WORDS)})$"))
    none = F.lit(None)
    ref = lambda q, c, n: F.struct(q.cast("string").alias("qualifier"), c.cast("string").alias("column"), n.cast("int").alias("query"))
    all_refs = F.concat(F.transform(dotted, lambda x: ref(F.regexp_extract(x, r"^(.*)\.[^.]*$", 1), F.substring_index(x, ".", -1), none)), F.transform(bare, lambda x: ref(none, x, none)), F.transform(queries, lambda x: ref(none, none, x)))
    each = items.select(*KEY, "scope", "branch", "pos", "nth", F.explode(F.array_distinct(all_refs)).alias("r"))
    return each.select(*KEY, "scope", "branch", "pos", "r.*", F.when(F.col("r.query").isNotNull(), F.col("nth")).alias("nth"))


def resolved(refs: DataFrame, frames: DataFrame, above: DataFrame, outputs: DataFrame) -> DataFrame:
    """Where each reference leads: KEY, scope, branch, pos, then table and column, or query and column or nth, or a reason why neither is known.

    frames: with WITH names replaced by their scopes; outputs: KEY, scope, pos, name.
    """
    at = [*KEY, "scope", "branch", "pos", "qualifier", "column"]
    # a qualifier: in the own branch, or else in the nearest scope around
    own = frames.select(*KEY, F.col("scope").alias("above"), F.col("branch").alias("b"), F.col("alias").alias("qualifier"), "table")
    seen = refs.where("qualifier is not null").join(above, [*KEY, "scope"]).join(own, [*KEY, "above", "qualifier"]).where("dist > 0 or b = branch")
    first = seen.withColumn("near", F.min("dist").over(W.Window.partitionBy(*at))).where("dist = near").select(*at, "table").distinct()
    qualified = refs.where("qualifier is not null").join(first, at, "left").select(*KEY, "scope", "branch", "pos", "table", "column", F.when(F.col("table").isNull(), F.concat(F.lit("unknown alias "), "qualifier")).alias("reason"))
    # a bare name: of the only table, or of the only query that has such a column; in the own branch, or else further out
    bare = refs.where("qualifier is null and column is not null").join(above, [*KEY, "scope"])
    tables = frames.select(*KEY, F.col("scope").alias("above"), F.col("branch").alias("b"), "alias", "table").withColumn("n", F.count("*").over(W.Window.partitionBy(*KEY, "above", "b")))
    exported = outputs.select(*KEY, F.concat(F.lit("#Q"), F.col("scope").cast("string")).alias("table"), F.col("name").alias("column"), F.lit(True).alias("exported")).distinct()
    met = bare.join(tables, [*KEY, "above"]).where("dist > 0 or b = branch").join(exported, [*KEY, "table", "column"], "left")
    unit = [*KEY, "scope", "branch", "pos", "column"]
    hits = met.where(F.col("exported") | ((F.col("n") == 1) & ~F.col("table").startswith("#Q")))
    level = hits.withColumn("near", F.min("dist").over(W.Window.partitionBy(*unit))).where("dist = near")
    single = level.groupBy(*unit).agg(F.min("table").alias("table"), F.count_distinct("alias").alias("hits")).where("hits = 1")
    unqualified = refs.where("qualifier is null and column is not null").join(single, unit, "left").select(*KEY, "scope", "branch", "pos", "table", "column", F.when(F.col("table").isNull(), F.concat(F.lit("no one table for "), "column")).alias("reason"))
    nested = refs.where("query is not null").select(*KEY, "scope", "branch", "pos", F.lit(None).cast("string").alias("table"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("reason"), "query", "nth")
    named = qualified.unionByName(unqualified).withColumns({"query": _query(F.col("table")), "nth": F.lit(None).cast("int")})
    return named.withColumn("table", F.when(F.col("query").isNull(), F.col("table"))).unionByName(nested).distinct()


def scope_columns(stmts: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Target columns with the base columns they come from, and statements that are not wholly known.

    stmts: KEY and stmt, as ``lineage.sql_statements`` gives them; declared: table, pos, column of tables, which stars need.
    Returns KEY, target, target_column, source (``table|column``), transformation (of the outermost expression, ``#Qn``
    for a nested query), filter; and gaps: KEY, target_column, reason.
    """
    spark = stmts.sparkSession
    declared = declared if declared is not None else spark.createDataFrame([], "table string, pos int, column string")
    scoped = settled(scopes(stmts))
    items, frames = query_items(scoped)
    assigned, assigned_frames = assignment_items(scoped)
    items, frames = items.withColumn("nth", F.lit(0)).unionByName(assigned), frames.unionByName(assigned_frames)
    above = ancestors(scoped)
    # names of WITH queries stand for their scopes, the nearest first
    named = with_queries(scoped)
    ctes = above.join(named.select(*KEY, F.col("scope").alias("above"), F.col("name").alias("table"), "query"), [*KEY, "above"]).withColumn("near", F.min("dist").over(W.Window.partitionBy(*KEY, "scope", "table"))).where("dist = near").select(*KEY, "scope", "table", "query")
    frames = settled(frames.join(ctes, [*KEY, "scope", "table"], "left").select(*KEY, "scope", "branch", "alias", F.coalesce(F.concat(F.lit("#Q"), F.col("query").cast("string")), "table").alias("table")))
    stated = named.select(*KEY, F.col("query").alias("scope"), F.posexplode("names").alias("pos", "name"))
    items = expanded(items, frames, stated, declared)
    heads = items.where("branch = 0").select(*KEY, "scope", "pos", "own", "names").join(stated, [*KEY, "scope", "pos"], "left")
    outputs = settled(heads.select(*KEY, "scope", "pos", F.coalesce(F.get("names", F.col("pos")), "name", "own").alias("name")))
    star = F.col("expr").rlike(r"^(?:[A-Z0-9_$#.]+\.)?\*$")
    starred = settled(items.where(star).join(frames, [*KEY, "scope", "branch"]).where(F.col("expr").isin("*") | (F.col("expr") == F.concat("alias", F.lit(".*")))).groupBy(*KEY, "scope").agg(F.min("table").alias("table"), F.count("*").alias("n")).where("n = 1").select(*KEY, "scope", F.col("table").alias("of")))
    leads = settled(resolved(references(items.where(~star)), frames, above, outputs))

    # from the targets inwards
    targets = items.where("scope = 0").join(outputs.where("scope = 0").select(*KEY, "pos", "name"), [*KEY, "pos"])
    targets = settled(targets.select(*KEY, "target", F.col("name").alias("target_column"), "branch", "pos", "expr", "filter"))
    steps = leads.select(*KEY, "scope", "branch", "pos", "table", "column", "query", "nth", "reason")
    kept = [*KEY, "branch_", "pos_", "table", "column", "reason"]
    new = settled(steps.where("scope = 0").withColumnsRenamed({"branch": "branch_", "pos": "pos_"}).select(*kept, "query", "nth").distinct())
    seen = new
    while True:
        inner = new.where("query is not null")
        if inner.isEmpty():
            break
        inner = inner.select(*KEY, "branch_", "pos_", F.col("query").alias("scope"), F.col("nth").alias("by_pos"), F.col("column").alias("by_name"))
        found = inner.join(outputs, [*KEY, "scope"]).where("pos = by_pos or name = by_name")
        reached = found.join(steps, [*KEY, "scope", "pos"]).select(*kept, "query", "nth")
        missing = inner.alias("i").join(outputs.alias("o"), [*[F.col(f"i.{c}") == F.col(f"o.{c}") for c in (*KEY, "scope")], (F.col("o.pos") == F.col("i.by_pos")) | (F.col("o.name") == F.col("i.by_name"))], "left_anti")
        # a star over one table passes any name on
        passed = missing.join(starred, [*KEY, "scope"], "left").select(
            *KEY, "branch_", "pos_",
            F.when(_query(F.col("of")).isNull(), F.col("of")).alias("table"), F.col("by_name").alias("column"),
            F.when(F.col("of").isNull() | F.col("by_name").isNull(), F.concat(F.lit("no column "), F.coalesce("by_name", F.col("by_pos").cast("string")), F.lit(" in a nested query"))).alias("reason"),
            _query(F.col("of")).alias("query"), F.lit(None).cast("int").alias("nth"),
        )
        new = settled(reached.unionByName(passed).subtract(seen))
        seen = seen.unionByName(new)
    direct = F.col("expr").rlike(r"^(?:[A-Z0-9_$#.]+\.)?[A-Z0-9_$]+$")
    how = F.when(direct, "direct").otherwise(S.clipped(F.col("expr"), 400))
    by_pos = seen.withColumnsRenamed({"branch_": "branch", "pos_": "pos"})
    columns = targets.join(by_pos.where("table is not null"), [*KEY, "branch", "pos"]).where("target_column <> ''").select(*KEY, "target", "target_column", F.concat_ws("|", "table", "column").alias("source"), how.alias("transformation"), S.clipped(F.col("filter"), 400).alias("filter")).distinct()
    lost = targets.join(by_pos.where("reason is not null"), [*KEY, "branch", "pos"]).select(*KEY, "target_column", "reason")
    open_stars = targets.where(star).select(*KEY, "target_column", F.lit("star over a table of unknown columns").alias("reason"))
    return columns, lost.unionByName(open_stars).distinct()


def scope_unmapped(stmts: DataFrame, columns: DataFrame, gaps: DataFrame) -> DataFrame:
    """Data statements that are not wholly known: KEY, statement_type, snippet. A statement with no column that stores no other table's data is known."""
    s = F.col("stmt")
    fixed = s.rlike(r"^INSERT INTO \S+ ?(?:\([^()]*\) ?)?VALUES\b") & ~S.without_literals(s).rlike(r"\b[A-Z][A-Z0-9_$#]*\.(?!NEXTVAL\b|CURRVAL\b)[A-Z0-9_$#]+(?! ?\()")
    idle = fixed | s.rlike("^(?:DELETE|EXECUTE IMMEDIATE)") | (s.rlike(r"^CREATE (?:GLOBAL TEMPORARY )?TABLE") & ~s.rlike(r"\) ?AS ?\(? ?SELECT|\bTABLE \S+ AS\b"))
    seen = stmts.where(s.rlike(rf"^(?:{DATA_VERBS})") & ~idle)
    open_ = gaps.select(*KEY).distinct().withColumn("open", F.lit(True))
    some = columns.select(*KEY).distinct().withColumn("some", F.lit(True))
    lost = seen.join(open_, KEY, "left").join(some, KEY, "left").where("open is not null or some is null")
    return lost.select(*KEY, F.lit("SQL_DML_UNMAPPED").alias("statement_type"), S.clipped(s, 300).alias("snippet"))
