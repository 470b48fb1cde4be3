"""Lineage facts and edges from statements: moves, layouts, cursors, calls, job steps, SQL statements, coverage gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.functions import scalars as S
from weftline.operators import graph as G
from weftline.session import settled
from weftline.sources.estate import without_comments

#: Words in expressions that are no variables.
WORDS = "TO OF IN BY FROM INTO GIVING REMAINDER ROUNDED SIZE DELIMITED FUNCTION TRIM LENGTH CURRENT-DATE REVERSE UPPER-CASE LOWER-CASE NUMVAL NUMVAL-C ZERO ZEROS ZEROES SPACE SPACES HIGH-VALUE HIGH-VALUES LOW-VALUE LOW-VALUES QUOTE QUOTES NULL NULLS AND OR NOT EQUAL GREATER LESS THAN IS ALL TRUE FALSE ALSO OTHER WHEN RECORD END-COMPUTE END-STRING END-ADD END-SUBTRACT END-MULTIPLY END-DIVIDE END-READ ON ERROR NEXT AT END".split()
#: Words in SQL expressions that are no columns.
SQL_WORDS = "SELECT FROM WHERE AS AND OR NOT IN IS NULL CASE WHEN THEN ELSE END BETWEEN LIKE DISTINCT OVER PARTITION BY ORDER DESC ASC NULLS FIRST LAST ROWS RANGE PRECEDING FOLLOWING UNBOUNDED ROW ON JOIN LEFT RIGHT FULL INNER OUTER GROUP HAVING UNION ALL EXISTS DATE TIMESTAMP TIME CURRENT INTERVAL YEAR MONTH DAY DAYS MONTHS YEARS SYSDATE SYSTIMESTAMP CURRENT_DATE CURRENT_TIMESTAMP USER ROWNUM LEVEL WITH UR FETCH ONLY USING".split()
#: The shape of a name in a program.
NAME = r"([A-Z][A-Z0-9-]*)"
#: A source that is a literal, a number or a figurative constant.
CONSTANT = r"^(?:ALL )?(?:['\"].*|[+-]?[0-9.,]+|ZERO(?:E?S)?|SPACES?|HIGH-VALUES?|LOW-VALUES?|QUOTES?|NULLS?|TRUE|FALSE|FUNCTION CURRENT-DATE.*)$"


def names_in(text, words=WORDS):
    """Distinct variables of an expression: literals, functions, qualifiers (OF, IN) and subscripts left out."""
    bare = F.regexp_replace(S.without_literals(text), r"\bFUNCTION [A-Z][A-Z0-9-]*", " ")
    bare = F.regexp_replace(bare, r"\b(?:OF|IN) [A-Z][A-Z0-9-]*", " ")
    bare = F.regexp_replace(bare, r"([A-Z][A-Z0-9-]*) ?\([^()]*+\)", "$1 ")
    found = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?<![A-Z0-9-])([A-Z][A-Z0-9-]*)(?![A-Z0-9-])"), F.lit(1)))
    # most texts are one name, which needs no more than a look
    one = F.when(text.isin(*words), F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(text.rlike(r"^[A-Z][A-Z0-9-]*\z"), one).otherwise(F.filter(found, lambda x: ~x.isin(*words)))


#: Statement shapes: kind, pattern, group of the sources, group of the targets.
SHAPES = [
    ("MOVE", r"^MOVE (?!CORR)(.+) TO (.+)$", 1, 2),
    ("COMPUTE", r"^COMPUTE (.+?) ?= ?(.+)$", 2, 1),
    ("STRING", r"^STRING (.+) INTO (.+?)(?: (?:WITH |ON |END-STRING).*)?$", 1, 2),
    ("GIVING", r"^(?:ADD|SUBTRACT|MULTIPLY|DIVIDE) (.+) GIVING (.+)$", 1, 2),
    ("ADD", r"^(?:(?:ADD|SUBTRACT|DIVIDE) (?:(?! GIVING ).)+ (?:TO|FROM|INTO)|MULTIPLY (?:(?! GIVING ).)+ BY) ((?:(?! GIVING ).)+)$", 0, 1),
]


def transforms(stmts: DataFrame) -> DataFrame:
    """program, seq, target, source, kind, logic: one row for each pair that a statement moves."""
    s = F.col("stmt")
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    shapes = []
    for kind, pattern, source, target in SHAPES:
        sources = F.regexp_replace(part(pattern, source), r"^(?:ADD|SUBTRACT|DIVIDE|MULTIPLY) ", "")
        shapes.append(F.when(s.rlike(pattern), F.struct(F.lit(kind).alias("kind"), part(pattern, target).alias("target"), sources.alias("source"))))
    # explode_outer, as Spark works an array out twice more before an inner explode to see whether it is empty
    found = stmts.select("program", "seq", "stmt", F.explode_outer(F.array(*shapes)).alias("x")).where("x is not null")
    names = found.select("program", "seq", names_in(F.col("x.target")).alias("targets"), names_in(F.col("x.source")).alias("sources"), "x.kind", S.clipped(s, 600).alias("logic"))
    each = names.select("program", "seq", F.explode_outer("targets").alias("target"), "sources", "kind", "logic").where("target is not null")
    out = each.select("program", "seq", "target", F.explode_outer("sources").alias("source"), "kind", "logic")
    return out.where("source is not null and not (kind = 'MOVE' and source = target)")


def reads_into(stmts: DataFrame, items: DataFrame) -> DataFrame:
    """READ … INTO as moves of the file's record, shaped like ``transforms``; items: ``data_items``."""
    pattern = r"^READ ([A-Z0-9-]+)(?: NEXT)?(?: RECORD)? INTO ([A-Z][A-Z0-9-]*)"
    g = lambda k: F.regexp_extract("stmt", pattern, k)
    found = stmts.where(F.col("stmt").rlike(pattern)).select("program", "seq", g(1).alias("fd"), g(2).alias("target"), S.clipped(F.col("stmt"), 600).alias("logic"))
    records = items.where("level = 1 and fd is not null").groupBy("program", "fd").agg(F.min_by("name", "ord").alias("source"))
    return found.join(records, ["program", "fd"]).select("program", "seq", "target", "source", F.lit("MOVE").alias("kind"), "logic")


def conditional_sources(stmts: DataFrame, moves: DataFrame) -> DataFrame:
    """EVALUATE and SEARCH blocks around a statement as sources of what it sets.

    Of an EVALUATE, these are all names of its subjects and conditions. Of a SEARCH, only the key arguments: the names
    of its conditions that have no subscript. Before its first WHEN stands its default, whose values depend on the key
    alone; after it, the looked-up field is a source as well, by the statement's own move. Without a key argument
    (an index that counts) a SEARCH adds nothing.

    Within a sentence, blocks of one depth follow each other, so each opening statement is ended
    by the next closing one of its depth, or by the end of the sentence.
    """
    order = W.Window.partitionBy("program", "sentence").orderBy("seq")
    opens, closes = F.col("verb").isin("EVALUATE", "SEARCH").cast("int"), F.col("verb").isin("END-EVALUATE", "END-SEARCH").cast("int")
    ends = stmts.where((opens + closes) > 0)
    numbered = ends.withColumn("after", F.sum(opens - closes).over(order)).withColumn("depth", F.col("after") + closes)
    level = W.Window.partitionBy("program", "sentence", "depth").orderBy("seq")
    search = F.nullif(F.regexp_extract("stmt", r"^(SEARCH (?:ALL )?[A-Z0-9-]+)", 1), F.lit(""))
    marks = numbered.select("program", "sentence", "seq", opens.alias("open"), search.alias("search"), F.lead("seq").over(level).alias("end"))
    blocks = settled(marks.where("open = 1").select("program", "sentence", F.col("seq").alias("block"), F.coalesce("end", F.lit(1 << 30)).alias("end"), "search"))
    within = lambda some: some.join(blocks, ["program", "sentence"]).where("seq >= block and seq <= end")
    # a condition belongs to the innermost block, whose drivers reach all that is inside it
    said = within(stmts.where(F.col("verb").isin("EVALUATE", "WHEN")).select("program", "sentence", "seq", "verb", "stmt"))
    said = said.groupBy("program", "seq", "verb", "stmt").agg(F.max("block").alias("block")).join(blocks.select("program", "block", "search"), ["program", "block"])
    condition = F.regexp_replace("stmt", r"^\S+ ", "")
    keys = F.regexp_replace(S.without_literals(condition), r"[A-Z][A-Z0-9-]*(?: (?:OF|IN) [A-Z][A-Z0-9-]*)* ?\([^()]*+\)", " ")
    drivers = said.withColumn("sources", names_in(F.when(F.col("search").isNull(), condition).otherwise(keys)))
    # a SEARCH block's default ends at its own first WHEN
    first = F.min(F.when((F.col("verb") == "WHEN") & F.col("search").isNotNull(), F.col("seq"))).alias("first")
    told = drivers.groupBy("program", "block", "search").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), first)
    region = F.when(F.col("first") < F.col("seq"), "lookup").otherwise("default")
    logic = F.when(F.col("search").isNull(), "depends on the condition").otherwise(S.clipped(F.concat("search", F.lit(": "), region, F.lit(" keyed on "), F.array_join("sources", ", ")), 600))
    literal = stmts.where(F.col("stmt").rlike("^MOVE .+ TO ")).select("program", "seq", F.explode_outer(names_in(F.regexp_extract("stmt", r"^MOVE .+ TO (.+)$", 1))).alias("target")).where("target is not null")
    targets = moves.select("program", "seq", "target").unionByName(literal).distinct()
    inside = within(stmts.select("program", "sentence", "seq")).select("program", "seq", "block").distinct()
    target = W.Window.partitionBy("program", "seq", "target")
    met = targets.join(inside, ["program", "seq"]).withColumn("n", F.count("*").over(target)).join(told, ["program", "block"])
    met = settled(met.select("program", "seq", "target", "n", "sources", logic.alias("logic")))
    each = lambda some: some.select("program", "seq", "target", F.explode("sources").alias("source"), F.lit("CONDITION").alias("kind"), "logic")
    # only where blocks are nested can a row be met twice
    return each(met.where("n = 1")).unionByName(each(met.where("n > 1")).distinct())


def data_items(progs: DataFrame) -> DataFrame:
    """program, ord, section, fd, level, name, pic, usage, valid: items in order, with their section and file carried down."""
    items = progs.select("program", F.posexplode(F.split("data", r"\.\s+|\.$")).alias("ord", "raw")).withColumn("raw", F.upper(F.trim(F.regexp_replace("raw", r"\s+", " "))))
    order = W.Window.partitionBy("program").orderBy("ord")
    pick = lambda pattern: F.nullif(F.regexp_extract("raw", pattern, 1), F.lit(""))
    section = F.last(pick(r"^([A-Z-]+) SECTION$"), ignorenulls=True).over(order)
    t = items.withColumn("section", section)
    t = t.withColumn("fd", F.when(F.col("section") == "FILE", F.last(pick(r"^FD ([A-Z0-9-]+)"), ignorenulls=True).over(order)))
    t = t.where(F.col("raw").rlike(r"^(0[1-9]|[1-4]\d|77) [A-Z0-9-]+"))
    level = F.regexp_extract("raw", r"^(\d\d) ", 1).cast("int")
    t = t.select("program", "ord", "section", "fd", level.alias("level"), pick(r"^\d\d ([A-Z0-9-]+)").alias("name"), pick(r" PIC(?:TURE)?(?: IS)? (\S+)").alias("pic"), pick(r" (COMP(?:-\d)?|BINARY|PACKED-DECIMAL)\b").alias("usage"), (~F.col("raw").rlike(r" (OCCURS|REDEFINES) ")).alias("valid"))
    group = W.Window.partitionBy("program").orderBy("ord")
    return t.withColumn("record", F.last(F.when(F.col("level") == 1, F.col("name")), ignorenulls=True).over(group))


def layouts(items: DataFrame) -> DataFrame:
    """Elementary fields of each record with byte offsets; records with OCCURS or REDEFINES are marked invalid: program, record, fd, field, ord, start, length, valid."""
    key = ["program", "section", "record"]
    fields = items.where("pic is not null and record is not null").withColumn("length", S.pic_length(F.col("pic"), F.col("usage")))
    upto = W.Window.partitionBy(*key).orderBy("ord").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    ok = items.groupBy(*key).agg(F.bool_and("valid").alias("ok"))
    out = fields.join(ok, key).withColumn("start", F.sum("length").over(upto) - F.col("length") + 1)
    return out.select("program", "section", "record", "fd", F.col("name").alias("field"), "ord", "start", "length", F.col("ok").alias("valid"))


def group_moves(moves: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Record moves as field pairs by byte start; and those that can't be aligned, for the coverage report."""
    records = fields.select("program", "record").distinct()
    grouped = moves.where("kind = 'MOVE'").join(records.withColumnRenamed("record", "source"), ["program", "source"]).join(records.withColumnRenamed("record", "target"), ["program", "target"])
    side = lambda c: fields.where("valid").select("program", F.col("record").alias(c), F.col("field").alias(f"{c}_field"), "start")
    pairs = grouped.join(side("source"), ["program", "source"]).join(side("target"), ["program", "target", "start"])
    out = pairs.select("program", "seq", F.col("target_field").alias("target"), F.col("source_field").alias("source"), F.lit("GROUP").alias("kind"), "logic")
    return out, grouped.join(pairs.select("program", "seq").distinct(), ["program", "seq"], "left_anti").select("program", "seq", F.lit("COBOL_GROUP_MOVE").alias("statement_type"), F.col("logic").alias("snippet"))


def file_bindings(progs: DataFrame) -> DataFrame:
    """program, file, dd from SELECT … ASSIGN TO …."""
    found = F.regexp_extract_all(F.upper("data"), F.lit(r"(SELECT\s+[A-Z0-9-]+\s+ASSIGN\s+(?:TO\s+)?[\"']?[A-Z0-9-]+)"), F.lit(1))
    t = progs.select("program", F.explode(found).alias("x"))
    return t.select("program", F.regexp_extract("x", r"SELECT\s+([A-Z0-9-]+)", 1).alias("file"), F.regexp_extract("x", r"([A-Z0-9-]+)$", 1).alias("dd"))


def open_modes(stmts: DataFrame) -> DataFrame:
    """program, file, direction: every file of an OPEN, I-O both ways."""
    found = F.regexp_extract_all("stmt", F.lit(r"((?:INPUT|OUTPUT|EXTEND|I-O)(?: (?!INPUT |OUTPUT |EXTEND |I-O )[A-Z0-9-]+)+)"), F.lit(1))
    t = stmts.where("verb = 'OPEN'").select("program", F.explode(found).alias("x"))
    mode = F.substring_index("x", " ", 1)
    each = t.select("program", mode.alias("mode"), F.explode(F.split(F.expr("substring(x, instr(x, ' ') + 1)"), " ")).alias("file"))
    ways = F.when(F.col("mode") == "INPUT", F.array(F.lit("READS_FROM"))).when(F.col("mode") == "I-O", F.array(F.lit("READS_FROM"), F.lit("WRITES_TO"))).otherwise(F.array(F.lit("WRITES_TO")))
    return each.select("program", "file", F.explode(ways).alias("direction"))


def cursors(stmts: DataFrame) -> DataFrame:
    """program, cursor, pos, expr, source tables: select items of declared cursors."""
    pattern = r"DECLARE ([A-Z0-9_-]+) CURSOR.* FOR SELECT (.+?) FROM (.+?)(?: WHERE .*| ORDER BY .*| END-EXEC.*)?$"
    t = stmts.where(F.col("stmt").rlike(r"^EXEC SQL DECLARE"))
    g = lambda k: F.regexp_extract("stmt", pattern, k)
    return t.select("program", g(1).alias("cursor"), F.posexplode(S.split_top(g(2))).alias("pos", "expr"), table_aliases(g(3)).alias("tables"))


def fetches(stmts: DataFrame) -> DataFrame:
    t = stmts.where(F.col("stmt").rlike(r"^EXEC SQL FETCH"))
    return t.select("program", F.regexp_extract("stmt", r"FETCH ([A-Z0-9_-]+)", 1).alias("cursor"), F.posexplode(F.regexp_extract_all("stmt", F.lit(r":([A-Z0-9-]+(?:\.[A-Z0-9-]+)?)"), F.lit(1))).alias("pos", "variable"))


def table_aliases(from_text):
    """A map from alias (and table name) to table of a FROM list with commas and joins."""
    cleaned = F.regexp_replace(F.regexp_replace(from_text, r" ON .*?(?= (?:LEFT|RIGHT|FULL|INNER|CROSS|JOIN)\b|$)", " "), r"\b(?:LEFT|RIGHT|FULL|INNER|CROSS)?(?: OUTER)? ?JOIN ", ", ")
    items = F.filter(F.transform(F.split(cleaned, ","), lambda x: F.trim(x)), lambda x: x != "")
    name = lambda x: F.regexp_extract(x, r"^([A-Z0-9_.$#]+)", 1)
    alias = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^[A-Z0-9_.$#]+ (?:AS )?([A-Z0-9_]+)$", 1), F.lit("")), name(x))
    return F.map_from_entries(F.array_distinct(F.flatten(F.transform(items, lambda x: F.array_distinct(F.array(F.struct(alias(x), name(x)), F.struct(name(x), name(x))))))))


def source_columns(expr, tables):
    """``table|column`` of each column in an expression: by alias, or bare if there is one table; nothing for an alias that the list lacks."""
    text = F.regexp_replace(S.without_literals(F.upper(expr)), r" AS [A-Z][A-Z0-9]*(?: ?\([^()]*+\))? ?\)", ")")
    qualified = F.regexp_extract_all(text, F.lit(r"([A-Z0-9_]+\.[A-Z0-9_]+)"), F.lit(1))
    qualified = F.filter(qualified, lambda x: F.map_contains_key(tables, F.substring_index(x, ".", 1)))
    q = F.transform(qualified, lambda x: F.concat(F.element_at(tables, F.substring_index(x, ".", 1)), F.lit("|"), F.substring_index(x, ".", -1)))
    bare = F.filter(F.regexp_extract_all(F.regexp_replace(text, r"[A-Z0-9_]+\.[A-Z0-9_]+", " "), F.lit(r"(?<![A-Z0-9_])([A-Z_][A-Z0-9_]*)(?!\s*\(|[A-Z0-9_])"), F.lit(1)), lambda x: ~x.rlike(f"^(?:{'|'.join(SQL_WORDS)})$"))
    only = F.array_distinct(F.map_values(tables))
    b = F.when(F.size(only) == 1, F.transform(bare, lambda x: F.concat(F.get(only, F.lit(0)), F.lit("|"), x))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(q, b))


def call_sites(stmts: DataFrame, progs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls of programs of the estate (program, seq, callee), their parameters (…, arg, param), and calls of others."""
    calls = stmts.where(F.col("stmt").rlike(r"^CALL ['\"]")).select("program", "seq", F.regexp_extract("stmt", r"^CALL ['\"]([A-Z0-9_-]+)['\"]", 1).alias("callee"), F.regexp_extract_all(F.regexp_extract("stmt", r" USING (.+)$", 1), F.lit(NAME), F.lit(1)).alias("args"), "stmt")
    params = progs.select(F.col("program").alias("callee"), "parameters")
    known = calls.join(params, "callee")
    missing = calls.join(params, "callee", "left_anti").select("program", "seq", F.lit("COBOL_CALL").alias("statement_type"), F.concat("stmt", F.lit(": not in the estate")).alias("snippet"))
    args = known.select("program", "seq", "callee", F.posexplode(F.filter("args", lambda x: ~x.isin("BY", "REFERENCE", "CONTENT", "VALUE", "ON", "END-CALL"))).alias("pos", "arg"), "parameters")
    pairs = args.select("program", "seq", "callee", "arg", F.get("parameters", F.col("pos")).alias("param")).where("param is not null")
    return known.select("program", "seq", "callee"), pairs, missing


def call_edges(sites: DataFrame) -> DataFrame:
    return sites.select(F.concat(F.lit("PROGRAM:"), "program").alias("source_id"), F.concat(F.lit("PROGRAM:"), "callee").alias("target_id"), F.lit("EXECUTES").alias("edge_type")).distinct()


def call_contexts(programs: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each program in each context it runs in, and how a call leads from one context to another.

    A context is the whole chain of call sites from the program that was started (``program#seq``, joined by ``>``),
    so two callers' callers stay apart too. A call of a program that is already on the chain leads back to its context
    there, so recursion ends. Every program can be started itself (an empty chain). A round extends the chains that
    the last one found by one call; there are as many contexts as there are call paths without a repeated program.

    programs: program; sites: program, seq, callee. Returns program, chain; and program, chain, seq, callee, callee_chain.
    """
    site = F.concat_ws("#", "program", "seq")
    sites = settled(sites.select("program", "seq", "callee").distinct())
    level = settled(programs.select("program").distinct().select("program", F.array().cast("array<string>").alias("chain"), F.array("program").alias("members")))
    contexts, links = level.select("program", "chain"), None
    while True:
        at = F.array_position("members", F.col("callee"))
        to = F.when(at > 0, F.slice("chain", 1, at.cast("int") - 1)).otherwise(F.concat("chain", F.array(site)))
        met = level.join(sites, "program").select("program", "chain", "members", "seq", "callee", to.alias("to"), (at == 0).alias("new"))
        met = settled(met)
        links = met if links is None else links.unionByName(met)
        level = met.where("new").select(F.col("callee").alias("program"), F.col("to").alias("chain"), F.concat("members", F.array("callee")).alias("members"))
        if level.isEmpty():
            break
        contexts = contexts.unionByName(level.select("program", "chain"))
    text = lambda c: F.array_join(c, ">")
    return contexts.select("program", text("chain").alias("chain")).distinct(), links.select("program", text("chain").alias("chain"), "seq", "callee", text("to").alias("callee_chain")).distinct()


def steps_in_context(moves: DataFrame, sites: DataFrame, pairs: DataFrame, contexts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Steps ``target, source, logic`` over variables named ``program@chain.variable``.

    Each program's moves hold once in each of its contexts (``call_contexts``), so that what one caller passes
    does not reach another; parameters are passed by reference, both ways.
    """
    contexts, links = contexts or call_contexts(moves.select("program").union(sites.select("program")), sites)
    name = lambda p, c, v: F.concat(F.col(p), F.lit("@"), F.col(c), F.lit("."), F.col(v))
    own = moves.join(contexts, "program").select(name("program", "chain", "target").alias("target"), name("program", "chain", "source").alias("source"), "logic")
    passed = pairs.join(links, ["program", "seq", "callee"]).select(name("callee", "callee_chain", "param").alias("a"), name("program", "chain", "arg").alias("b"))
    call = F.lit("CALL").alias("logic")
    return own.union(passed.select("a", "b", call)).union(passed.select("b", "a", call)).where("target <> source").distinct()


# --- jobs ------------------------------------------------------------------------------

#: Utilities, programs that do nothing, and monitors that run another program.
UTILITIES = ("SORT", "DFSORT", "SYNCSORT", "ICEMAN", "ICETOOL", "IDCAMS", "IEBGENER", "IEBCOPY", "FTP", "DSNTIAUL", "DSNTEP2", "DSNTEP4", "DSNUTILB")
IDLE = ("IEFBR14",)
MONITORS = ("IKJEFT01", "IKJEFT1A", "IKJEFT1B")


def job_steps(stmts: DataFrame) -> DataFrame:
    """path, job, step, program, line, and the DDs below each step belong to the last EXEC before them."""
    order = W.Window.partitionBy("path").orderBy("line")
    t = stmts.withColumn("job", F.last(F.when(F.col("op") == "JOB", F.col("name")), ignorenulls=True).over(order))
    t = t.withColumn("step", F.last(F.when(F.col("op") == "EXEC", F.col("name")), ignorenulls=True).over(order))
    pgm = F.nullif(F.regexp_extract("operands", r"PGM=([A-Z0-9$#@]+)", 1), F.lit(""))
    return t.withColumn("program", F.last(F.when(F.col("op") == "EXEC", F.coalesce(pgm, F.lit(""))), ignorenulls=True).over(order))


def dd_statements(steps: DataFrame) -> DataFrame:
    """job, step, program, dd, dsn, direction, data: NEW and MOD write, others read; an empty first part of DISP is NEW.

    A step of a monitor counts for the program that its SYSTSIN deck runs.
    """
    run = steps.where(F.col("program").isin(*MONITORS) & (F.col("name") == "SYSTSIN")).select("path", "step", F.nullif(F.regexp_extract(F.array_join("data", " "), r"(?i)PROGRAM\s*\(\s*(\w+)\s*\)", 1), F.lit("")).alias("run"))
    dds = steps.where("op = 'DD'").join(run, ["path", "step"], "left").withColumn("program", F.coalesce("run", "program"))
    dsn = F.nullif(F.regexp_extract("operands", r"DSN=([^,\s]+)", 1), F.lit(""))
    disp = F.regexp_extract("operands", r"DISP=\(?([A-Z]*)", 1)
    writes = disp.isin("NEW", "MOD") | ((disp == "") & F.col("operands").rlike(r"DISP=\(,"))
    node = F.when(F.col("program").isin(*UTILITIES), F.concat_ws(".", "program", "job", "step")).otherwise(F.col("program"))
    return dds.select("path", "job", "step", node.alias("program"), F.col("name").alias("dd"), dsn.alias("dsn"), F.when(writes, "WRITES_TO").otherwise("READS_FROM").alias("direction"), "data", "line")


def job_edges(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """Job to program, and utilities' datasets."""
    run = dds.select("job", "program").union(steps.where(F.col("op") == "EXEC").where(~F.col("program").isin(*IDLE, *MONITORS, *UTILITIES, "")).select("job", "program")).where(~F.col("program").isin(*IDLE, *MONITORS))
    executes = run.select(F.concat(F.lit("JOB:"), "job").alias("source_id"), F.concat(F.lit("PROGRAM:"), "program").alias("target_id"), F.lit("EXECUTES").alias("edge_type"))
    own = dds.where(F.substring_index("program", ".", 1).isin(*UTILITIES) & F.col("dsn").isNotNull())
    file, prog = F.concat(F.lit("FILE:"), "dsn"), F.concat(F.lit("PROGRAM:"), "program")
    read = F.col("direction") == "READS_FROM"
    return executes.unionByName(own.select(F.when(read, file).otherwise(prog).alias("source_id"), F.when(read, prog).otherwise(file).alias("target_id"), F.col("direction").alias("edge_type"))).distinct()


def linked_files(bindings: DataFrame, modes: DataFrame, dds: DataFrame) -> DataFrame:
    """Entity edges of programs' files, by the dataset that each job step binds their DD to; unbound files keep a logical name."""
    files = bindings.join(modes, ["program", "file"])
    bound = files.join(dds.where("dsn is not null").select("program", "dd", "dsn").distinct(), ["program", "dd"], "left")
    file = F.concat(F.lit("FILE:"), F.coalesce("dsn", F.concat_ws(".", "program", "file")))
    prog, read = F.concat(F.lit("PROGRAM:"), "program"), F.col("direction") == "READS_FROM"
    return bound.select(F.when(read, file).otherwise(prog).alias("source_id"), F.when(read, prog).otherwise(file).alias("target_id"), F.col("direction").alias("edge_type")).distinct()


# --- SQL files -------------------------------------------------------------------------


def sql_statements(files: DataFrame) -> DataFrame:
    """path, program, seq, offset (in the text), stmt: statements of SQL files, comments taken off, upper case; the program is the first procedure or the file."""
    t = files.where("language = 'SQL'").select("path", "member", without_comments(F.col("text")).alias("text"))
    proc = F.regexp_extract(F.upper("text"), r"CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE\s+([A-Z0-9_.]+)", 1)
    each = t.select("path", F.when(proc == "", F.col("member")).otherwise(proc).alias("program"), F.posexplode(F.split("text", ";")).alias("seq", "raw"))
    before = W.Window.partitionBy("path").orderBy("seq").rowsBetween(W.Window.unboundedPreceding, -1)
    # what comes before the first data verb of a piece is no part of the statement
    verb = F.regexp_instr("raw", F.lit(r"(?i)\b(?:" + DATA_VERBS.replace(" ", r"\s+") + r")\b")) - 1
    skipped = F.when(verb >= 0, verb).otherwise(F.length(F.regexp_extract("raw", r"^(\s*)", 1)))
    offset = F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)) + skipped
    start = rf"^.*?\b(?=(?:{DATA_VERBS})\b)"
    stmt = F.trim(F.regexp_replace(F.upper(F.regexp_replace("raw", r"\s+", " ")), start, ""))
    return each.select("path", "program", "seq", offset.alias("offset"), stmt.alias("stmt")).where("stmt <> ''")


#: Beginnings of statements that move or define data.
DATA_VERBS = r"INSERT INTO|INSERT ALL|INSERT FIRST|MERGE INTO|UPDATE [A-Z0-9_.$#]+(?: AS)?(?: [A-Z0-9_]+)? SET|DELETE FROM|CREATE (?:OR REPLACE )?(?:(?:NO )?FORCE )?(?:EDITIONABLE )?(?:MATERIALIZED )?VIEW|CREATE (?:GLOBAL TEMPORARY )?TABLE|EXECUTE IMMEDIATE|WITH [A-Z0-9_]+ AS"
#: Beginnings of the parts of a query, and words between queries.
CLAUSES = "SELECT|FROM|WHERE|GROUP BY|HAVING|ORDER BY|START WITH|CONNECT BY|WITH UR|FETCH FIRST"
SETS = "UNION ALL|UNION|MINUS|INTERSECT|EXCEPT"
TARGET = r"^(?:INSERT INTO|CREATE (?:OR REPLACE )?VIEW|CREATE MATERIALIZED VIEW|CREATE (?:GLOBAL TEMPORARY )?TABLE) ([A-Z0-9_.$#]+)"


def clause(parts, key: str):
    """Text of the first part with a key, null if there is none."""
    return F.get(F.transform(F.filter(parts, lambda p: p["key"] == key), lambda p: p["text"]), F.lit(0))


def sql_branches(stmts: DataFrame) -> DataFrame:
    """Every query of INSERT … SELECT, CREATE TABLE … AS and views, one row for each branch of a UNION.

    program, seq, branch, kind, target, names (stated columns), select, from, where, complete:
    whether all its columns can be read off (no nested query in FROM, no bare star).
    """
    s = F.col("stmt")
    t = stmts.where(s.rlike(TARGET) & s.rlike(r"\bSELECT\b") & ~s.rlike(r"^INSERT INTO \S+ ?(?:\([^()]*\) ?)?WITH "))
    body = F.regexp_replace(s, TARGET, "")
    names = F.regexp_extract(body, r"^ ?\(([^()]*)\)", 1)
    query = F.regexp_replace(body, r"^ ?(?:\([^()]*\))?.*?(?=\(? ?SELECT\b)", "")
    query = F.when(query.rlike(r"^\( ?SELECT.*\)$"), F.regexp_replace(query, r"^\((.*)\)$", "$1")).otherwise(query)
    kind = F.when(s.rlike("^INSERT"), "INSERT").when(s.rlike("VIEW"), "VIEW").otherwise("TABLE")
    each = t.select("program", "seq", kind.alias("kind"), F.regexp_extract("stmt", TARGET, 1).alias("target"), S.split_top(names).alias("names"), F.posexplode(S.clauses(query, SETS)).alias("branch", "q"))
    each = each.select("program", "seq", "branch", "kind", "target", "names", S.clauses(F.regexp_replace(F.col("q.text"), r"^\( ?(.*?) ?\)$", "$1"), CLAUSES).alias("parts"))
    out = each.select("program", "seq", "branch", "kind", "target", "names", F.regexp_replace(clause("parts", "SELECT"), r"^(?:DISTINCT|ALL) ", "").alias("select"), F.coalesce(clause("parts", "FROM"), F.lit("")).alias("from"), clause("parts", "WHERE").alias("where"))
    star = F.exists(S.split_top(F.col("select")), lambda x: x.rlike(r"^(?:[A-Z0-9_]+\.)?\*$"))
    return out.where("select is not null").withColumn("complete", ~star & ~F.col("from").rlike(r"\( ?SELECT\b"))


def sql_columns(stmts: DataFrame) -> DataFrame:
    """program, seq, target, target_column, sources, transformation, filter of INSERT … SELECT, CREATE TABLE … AS and views, item by item; of a UNION's later branches too, under the first one's names."""
    t = sql_branches(stmts)
    each = t.select("program", "seq", "branch", "target", "names", "where", table_aliases(F.col("from")).alias("tables"), F.posexplode(S.split_top(F.col("select"))).alias("pos", "item"))
    alias = F.regexp_extract("item", r"[^.](?: AS | )([A-Z_][A-Z0-9_$#]*)$", 1)
    alias = F.when(alias.isin("END", "NULL"), "").otherwise(alias)
    expr = F.when(alias != "", F.regexp_replace("item", r"(?: AS)? [A-Z_][A-Z0-9_$#]*$", "")).otherwise(F.col("item"))
    own = F.coalesce(F.get("names", F.col("pos")), F.nullif(alias, F.lit("")), F.nullif(F.regexp_extract("item", r"^(?:[A-Z0-9_]+\.)?([A-Z0-9_$#]+)$", 1), F.lit("")), F.regexp_extract("item", r"([A-Z0-9_]+)\)?$", 1))
    first = F.first("own").over(W.Window.partitionBy("program", "seq", "pos").orderBy("branch"))
    each = each.withColumns({"own": own, "expr": expr}).withColumn("target_column", first)
    direct = F.col("expr").rlike(r"^(?:[A-Z0-9_]+\.)?[A-Z0-9_$#]+$")
    out = each.select("program", "seq", "target", "target_column", source_columns(F.col("expr"), F.col("tables")).alias("sources"), F.when(direct, "direct").otherwise(S.clipped(F.col("expr"), 400)).alias("transformation"), S.clipped(F.col("where"), 400).alias("filter"))
    return out.where((F.size("sources") > 0) & (F.col("target_column") != ""))


def tables_read(text):
    """Names after FROM, JOIN and USING at any depth, and those of comma lists."""
    lists = F.regexp_extract_all(text, F.lit(r"\b(?:FROM|JOIN|USING) ((?:[A-Z][A-Z0-9_.$#]*(?: (?:AS )?(?!(?:WHERE|ON|LEFT|RIGHT|FULL|INNER|CROSS|JOIN|GROUP|ORDER|UNION|WHEN|SET|USING|HAVING|MINUS|INTERSECT|EXCEPT|START|CONNECT|WITH|FETCH|FOR|SELECT)\b)[A-Z0-9_]+)?(?: ?, ?)?)+)"), F.lit(1))
    names = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.regexp_extract(x, r"^ ?([A-Z][A-Z0-9_.$#]*)", 1))
    return F.array_distinct(F.filter(names, lambda x: ~x.isin("", "DUAL", "SYSIBM.SYSDUMMY1")))


def sql_edges(stmts: DataFrame) -> DataFrame:
    """Entity edges of INSERT, MERGE, UPDATE, DELETE and CREATE TABLE … AS (through the program) and views (table to view)."""
    program = F.concat(F.lit("PROGRAM:"), "program")
    named = lambda c: F.concat(F.lit("TABLE:"), c)
    s = F.col("stmt")
    ctes = F.regexp_extract_all("stmt", F.lit(r"(?:\bWITH |\), ?)([A-Z0-9_]+) AS ?\("), F.lit(1))
    read = F.array_except(tables_read(F.regexp_replace(s, "^DELETE FROM", "DELETE")), ctes)
    written = F.regexp_extract("stmt", r"^(?:INSERT INTO|MERGE INTO|DELETE FROM|UPDATE|CREATE (?:GLOBAL TEMPORARY )?TABLE) ([A-Z0-9_.$#]+)", 1)
    moving = s.rlike(r"^(?:INSERT INTO|MERGE INTO|DELETE FROM|UPDATE \S+(?: \S+)? SET)") | s.rlike(r"^CREATE (?:GLOBAL TEMPORARY )?TABLE .*\bSELECT\b")
    t = stmts.where(moving & (written != "")).select(program.alias("p"), written.alias("w"), F.explode_outer(read).alias("r"))
    out = t.select(F.col("p").alias("source_id"), named("w").alias("target_id"), F.lit("WRITES_TO").alias("edge_type"))
    out = out.union(t.where("r is not null").select(named("r"), "p", F.lit("READS_FROM")))
    views = stmts.where(s.rlike(r"^CREATE (?:OR REPLACE )?(?:MATERIALIZED )?VIEW")).select(named(F.regexp_extract("stmt", r"VIEW ([A-Z0-9_.$#]+)", 1)).alias("target_id"), F.explode(read).alias("t"))
    return out.union(views.select(named("t"), "target_id", F.lit("TRANSFORMS_TO"))).distinct()


def table_columns(stmts: DataFrame) -> DataFrame:
    """program, seq, table, pos, column, external: column lists of CREATE TABLE; constraints left out."""
    s = F.col("stmt")
    t = stmts.where(s.rlike(r"^CREATE (?:GLOBAL TEMPORARY )?TABLE \S+ ?\(") & ~s.rlike(r"\) ?AS ?\(? ?SELECT"))
    body = F.get(F.transform(F.filter(S.clauses(F.regexp_replace(s, r"^CREATE (?:GLOBAL TEMPORARY )?TABLE \S+ ?", ""), "ORGANIZATION|TABLESPACE|PARTITION BY|ON COMMIT|IN"), lambda p: p["key"] == ""), lambda p: p["text"]), F.lit(0))
    items = S.split_top(F.regexp_replace(body, r"^\((.*)\)[^)]*$", "$1"))
    each = t.select("program", "seq", F.regexp_extract("stmt", r"TABLE ([A-Z0-9_.$#]+)", 1).alias("table"), F.posexplode(items).alias("pos", "item"), s.rlike(r"\bORGANIZATION EXTERNAL\b").alias("external"))
    return each.where(~F.col("item").rlike(r"^(?:CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK|SUPPLEMENTAL)\b")).select("program", "seq", "table", "pos", F.regexp_extract("item", r"^([A-Z0-9_$#]+)", 1).alias("column"), "external")


def external_fields(stmts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """External tables: their files (program, seq, table, file, format), and their fields by order (…, pos, field, start, end)."""
    s = F.col("stmt")
    t = stmts.where(s.rlike(r"^CREATE TABLE .*\bORGANIZATION EXTERNAL\b"))
    name = F.regexp_extract("stmt", r"TABLE ([A-Z0-9_.$#]+)", 1)
    located = F.regexp_extract_all(F.regexp_extract("stmt", r"\bLOCATION ?\(([^()]*)\)", 1), F.lit("'([^']+)'"), F.lit(1))
    kind = F.when(s.rlike(r"XMLTAG|ENCLOSED BY ['\"]<|DELIMITED BY ['\"]<"), "XML").when(s.rlike(r"\bPOSITION\b"), "POSITIONAL").otherwise("DELIMITED")
    found = t.select("program", "seq", name.alias("table"), F.explode(located).alias("file"), kind.alias("format"))
    inner = F.element_at(F.split("stmt", r"\bFIELDS\b"), -1)
    field = r"([A-Z0-9_$#]+) POSITION ?\( ?(\d+) ?[:-] ?(\d+) ?\)"
    fields = t.where(s.rlike(r"\bPOSITION\b")).select("program", "seq", name.alias("table"), F.posexplode(F.regexp_extract_all(inner, F.lit(rf"({field})"), F.lit(1))).alias("pos", "x"))
    fields = fields.select("program", "seq", "table", "pos", *[F.regexp_extract("x", field, k).cast(c).alias(n) for k, c, n in ((1, "string", "field"), (2, "int", "start"), (3, "int", "end"))])
    return found, fields


# --- coverage --------------------------------------------------------------------------

#: Statement types of COBOL text that nothing maps.
DETECTORS = {
    "COBOL_UNSTRING": r"^UNSTRING ", "COBOL_MOVE_CORRESPONDING": r"^MOVE CORR", "COBOL_WRITE_FROM": r"^WRITE \S+ FROM ", "COBOL_EXEC_CICS": r"^EXEC CICS",
    "COBOL_ACCEPT": r"^ACCEPT ", "COBOL_INSPECT": r"^INSPECT ", "COBOL_INITIALIZE": r"^INITIALIZE ", "COBOL_REWRITE": r"^REWRITE ",
}
#: Embedded verbs that move nothing, or that another channel takes.
BENIGN = "INCLUDE OPEN CLOSE COMMIT ROLLBACK WHENEVER CONNECT SET LOCK DECLARE FETCH PREPARE EXECUTE BEGIN END".split()


def cobol_gaps(stmts: DataFrame, moves: DataFrame) -> DataFrame:
    """Statements that no channel has taken: program, seq, statement_type, snippet.

    Statements that set a variable are seen less those that ``moves`` (program, seq) has mapped and those whose
    sources are constants; embedded data verbs other than SELECT … INTO and INSERT are never mapped.
    """
    kind = None
    for name, pattern in DETECTORS.items():
        cond = F.col("stmt").rlike(pattern)
        kind = F.when(cond, name) if kind is None else kind.when(cond, name)
    verb = F.regexp_extract("stmt", r"^EXEC SQL (\w+)", 1)
    kind = kind.when((verb != "") & ~verb.isin(*BENIGN, "INSERT", "SELECT"), F.concat(F.lit("EXEC_SQL_"), verb))
    constant = F.lit(False)
    for _, pattern, source, target in SHAPES:
        part = F.regexp_replace(F.regexp_extract("stmt", pattern, source), r"^(?:ADD|SUBTRACT|DIVIDE|MULTIPLY) ", "")
        constant = constant | (F.col("stmt").rlike(pattern) & (F.size(names_in(F.regexp_extract("stmt", pattern, target))) > 0) & (part.rlike(CONSTANT) | (F.size(names_in(part)) == 0)))
    seen = F.col("verb").isin("MOVE", "COMPUTE", "STRING", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE") | F.col("stmt").rlike("^READ .* INTO ") | verb.isin("INSERT", "SELECT")
    known = stmts.select("program", "seq", "stmt", kind.alias("statement_type"), (seen & ~constant).alias("seen"), F.concat(F.lit("COBOL_"), F.when(verb != "", F.concat(F.lit("SQL_"), verb)).otherwise(F.col("verb"))).alias("unmapped"))
    told = known.where("statement_type is not null").select("program", "seq", "statement_type", S.clipped(F.col("stmt"), 300).alias("snippet"))
    if moves is None:
        return told
    itself = F.regexp_extract("stmt", r"^MOVE (\S+) TO \1$", 1) == ""
    lost = known.where("statement_type is null and seen").where(itself).join(moves.select("program", "seq").distinct(), ["program", "seq"], "left_anti")
    return told.unionByName(lost.select("program", "seq", F.regexp_replace("unmapped", "^COBOL_SQL_", "EXEC_SQL_").alias("statement_type"), S.clipped(F.col("stmt"), 300).alias("snippet")))


def dynamic_constructs(stmts: DataFrame, sql: DataFrame) -> DataFrame:
    """Statements whose text is only known at run time: program, construct_type, snippet, context (the last statements that set the text)."""
    shape = r"^EXEC SQL (?:PREPARE \S+ FROM|EXECUTE IMMEDIATE) :?([A-Z0-9-]+)"
    d = stmts.where(F.col("stmt").rlike(r"^EXEC SQL (PREPARE|EXECUTE)")).select("program", "seq", "stmt", F.regexp_extract("stmt", shape, 1).alias("variable"))
    built = transforms(stmts).select("program", F.col("seq").alias("at"), F.col("target").alias("variable"), "logic").distinct()
    literal = stmts.where(F.col("stmt").rlike("^MOVE .+ TO ")).select("program", F.col("seq").alias("at"), F.explode(names_in(F.regexp_extract("stmt", r"^MOVE .+ TO (.+)$", 1))).alias("variable"), S.clipped(F.col("stmt"), 600).alias("logic"))
    before = d.join(built.unionByName(literal).distinct(), ["program", "variable"]).where("at < seq").groupBy("program", "seq").agg(F.array_sort(F.collect_set(F.struct("at", "logic"))).alias("c"))
    embedded = d.join(before, ["program", "seq"], "left").select("program", F.lit("DYNAMIC_SQL").alias("construct_type"), S.clipped(F.col("stmt"), 300).alias("snippet"), F.coalesce(F.array_join(F.slice("c.logic", F.greatest(F.size("c") - 4, F.lit(1)), F.lit(5)), "; "), F.lit("")).alias("context"))
    return embedded.unionByName(sql.where("stmt like 'EXECUTE IMMEDIATE%'").select("program", F.lit("DYNAMIC_SQL").alias("construct_type"), S.clipped(F.col("stmt"), 300).alias("snippet"), F.lit("").alias("context")))


def job_gaps(steps: DataFrame) -> DataFrame:
    o = F.col("operands")
    kind = (
        F.when(F.col("op") == "INCLUDE", "JCL_INCLUDE")
        .when((F.col("op") == "EXEC") & ~o.rlike("PGM="), "JCL_PROC")
        .when((F.col("op") == "DD") & o.rlike(r"DSN=\*\."), "JCL_REFERBACK")
        .when((F.col("op") == "DD") & o.rlike(r"DSN=[^,]*\([+-]?\d+\)"), "JCL_GDG")
        .when((F.col("op") == "DD") & o.rlike(r"DSN=[^,]*\([A-Z]\w*\)"), "JCL_PDS_MEMBER")
        .when((F.col("op") == "DD") & o.rlike(r"DSN=[^,]*&"), "JCL_SYMBOLIC")
    )
    return steps.select(F.coalesce("job", F.lit("")).alias("program"), kind.alias("statement_type"), S.clipped(o, 300).alias("snippet"), F.col("path").alias("file"), "line").where("statement_type is not null")


def sql_gaps(stmts: DataFrame) -> DataFrame:
    """Data statements that no column could be read off, in whole or in a branch: program, seq, statement_type, snippet."""
    s = F.col("stmt")
    constant = s.rlike(r"^INSERT INTO \S+ ?(?:\([^()]*\) ?)?VALUES\b") | s.rlike("^(?:DELETE FROM|EXECUTE IMMEDIATE)") | (s.rlike(r"^CREATE (?:GLOBAL TEMPORARY )?TABLE") & ~s.rlike(r"\) ?AS ?\(? ?SELECT|\bTABLE \S+ AS\b"))
    seen = stmts.where(s.rlike(rf"^(?:{DATA_VERBS})\b") & ~constant)
    branches = sql_branches(stmts).groupBy("program", "seq").agg(F.bool_and("complete").alias("ok"))
    columns = assignments(stmts).select("program", "seq").distinct().withColumn("assigned", F.lit(True))
    both = seen.join(branches, ["program", "seq"], "left").join(columns, ["program", "seq"], "left")
    nested = s.rlike(r"\bUSING ?\( ?SELECT\b")
    lost = both.where(~(F.coalesce("ok", F.lit(False)) | (F.coalesce("assigned", F.lit(False)) & ~nested)))
    return lost.select("program", "seq", F.lit("SQL_DML_UNMAPPED").alias("statement_type"), S.clipped(s, 300).alias("snippet"))


def traced(steps: DataFrame, outputs: DataFrame, origins: DataFrame, depth: int = G.RESOLVE_DEPTH) -> DataFrame:
    """Origins that flow into outputs: output, origin, path (the statements on the way, source first; the least of the shortest).

    Breadth-first from the outputs against the steps; each round joins only what the last one found.
    """
    steps = settled(steps)
    frontier = settled(outputs.select(F.col("name").alias("output"), F.col("name").alias("at"), F.array().cast("array<string>").alias("path")).distinct())
    reached = frontier
    for _ in range(depth):
        new = frontier.join(steps.withColumnRenamed("target", "at"), "at").groupBy("output", F.col("source").alias("at")).agg(F.min(F.concat(F.array("logic"), "path")).alias("path"))
        frontier = settled(new.join(reached.select("output", "at"), ["output", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached.join(origins.select(F.col("name").alias("at")).distinct(), "at", "left_semi").select("output", F.col("at").alias("origin"), "path")


# --- unloads, transfers and assignments ------------------------------------------------


def unloads(dds: DataFrame) -> DataFrame:
    """Unload steps: the n-th SELECT of the SYSIN deck with the n-th SYSREC dataset: program, pos, table, columns, dsn."""
    own = dds.where(F.substring_index("program", ".", 1) == "DSNTIAUL")
    deck = own.where("dd = 'SYSIN'").select("program", F.upper(F.regexp_replace(F.array_join("data", " "), r"\s+", " ")).alias("text"))
    each = deck.select("program", F.posexplode(F.filter(F.transform(F.split("text", ";"), lambda x: F.trim(x)), lambda x: x.startswith("SELECT"))).alias("pos", "stmt"))
    g = lambda k: F.regexp_extract("stmt", r"^SELECT (.+?) FROM ([A-Z0-9_.]+)", k)
    records = own.where("dd like 'SYSREC%'").select("program", "dsn", (F.row_number().over(W.Window.partitionBy("program").orderBy("dd")) - 1).alias("pos"))
    return each.select("program", "pos", g(2).alias("table"), S.split_top(g(1)).alias("columns")).join(records, ["program", "pos"])


def unload_aliases(unloaded: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields of a reader's record as names of the unloaded columns, paired in order; and records that don't align.

    unloaded: dsn, columns; fields: dsn, program, field, ord, start, length. They align if the
    numbers are equal and the fields lie side by side from byte 1.
    """
    cols = unloaded.select("dsn", F.posexplode("columns").alias("pos", "column"), F.size("columns").alias("n"))
    key = W.Window.partitionBy("dsn", "program")
    f = fields.withColumn("pos", F.row_number().over(key.orderBy("ord")) - 1)
    before = F.coalesce(F.lag(F.col("start") + F.col("length")).over(key.orderBy("ord")), F.lit(1))
    f = f.withColumn("side", before == F.col("start")).withColumns({"all_side": F.min("side").over(key), "m": F.count("*").over(key)})
    met = f.join(cols, ["dsn", "pos"])
    ok = F.col("all_side") & (F.col("m") == F.col("n"))
    gaps = met.where(~ok).select("program", F.lit("UNLOAD_FD_ALIAS").alias("statement_type"), F.col("dsn").alias("snippet")).distinct()
    return met.where(ok).select("dsn", "program", "field", "column"), gaps


def transfers(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transfers of datasets: file edges through the step, and remote names with symbols as ``*`` templates (template, dsn)."""
    lines = steps.where("program = 'FTP'").select("job", "step", F.explode("data").alias("x"))
    g = lambda k: F.regexp_extract("x", r"(?i)^\s*put\s+'([^']+)'\s+'?([^'\s]+)'?", k)
    puts = lines.select("job", "step", F.upper(g(1)).alias("dsn"), g(2).alias("remote")).where("dsn <> ''")
    template = F.regexp_replace("remote", r"&\w+\.?", "*")
    node = F.concat_ws(".", F.lit("PROGRAM:FTP"), "job", "step")
    edges = puts.select(F.concat(F.lit("FILE:"), "dsn").alias("source_id"), node.alias("target_id"), F.lit("READS_FROM").alias("edge_type"))
    edges = edges.union(puts.select(node, F.concat(F.lit("FILE:"), template), F.lit("WRITES_TO")))
    return edges.distinct(), puts.where("remote like '%&%'").select(template.alias("template"), "dsn")


def assignments(stmts: DataFrame) -> DataFrame:
    """Columns set by UPDATE and MERGE … UPDATE: program, seq, target, target_column, sources, transformation."""
    update = r"^UPDATE ([A-Z0-9_.]+)(?: ([A-Z0-9_]+))? SET (.+?)(?: WHERE (.*))?$"
    merge = r"^MERGE INTO ([A-Z0-9_.]+)(?: ([A-Z0-9_]+))? USING ([A-Z0-9_.]+)(?: ([A-Z0-9_]+))? ON .*? WHEN MATCHED THEN UPDATE SET (.+?)(?: WHEN NOT MATCHED .*)?$"

    def rows(pattern, set_part, tables):
        t = stmts.where(F.col("stmt").rlike(pattern))
        g = lambda k: F.regexp_extract("stmt", pattern, k)
        each = t.select("program", "seq", g(1).alias("target"), tables(g).alias("tables"), F.explode(S.split_top(g(set_part))).alias("item"))
        column = F.regexp_extract("item", r"^(?:[A-Z0-9_]+\.)?([A-Z0-9_]+) ?=", 1)
        expr = F.trim(F.regexp_replace("item", r"^[^=]*= ?", ""))
        return each.select("program", "seq", "target", column.alias("target_column"), source_columns(expr, F.col("tables")).alias("sources"), S.clipped(expr, 400).alias("transformation"))

    one = lambda g: table_aliases(F.concat_ws(" ", g(1), g(2)))
    two = lambda g: table_aliases(F.concat(F.trim(F.concat_ws(" ", g(1), g(2))), F.lit(", "), F.trim(F.concat_ws(" ", g(3), g(4)))))
    return rows(update, 3, one).unionByName(rows(merge, 5, two))
