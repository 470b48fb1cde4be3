"""The lineage of a whole estate: one call from source files to nodes, edges, column edges, run-time constructs and unparsed statements.

Every statement that moves data ends in one of these tables; ``unparsed`` is what was seen less
what the others took. Facts are written between stages, so each stage's plan stays small and a
lost executor costs one stage.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import graph as G
from weftline.operators import joins as J
from weftline.operators import lineage as L
from weftline.operators import scopes as SC
from weftline.operators import sortsteps as SS
from weftline.session import settled
from weftline.sources import estate as E


class Lineage(NamedTuple):
    """nodes: id, kind, name, language, path, columns; edges: source_id, target_id, edge_type;
    column_edges: source_id, target_id, program, transformation; dynamic: program, construct_type, snippet, context;
    unparsed: program, statement_type, snippet, file, line (null where a gap is of a whole deck or dataset)."""

    nodes: DataFrame
    edges: DataFrame
    column_edges: DataFrame
    dynamic: DataFrame
    unparsed: DataFrame


def _id(kind: str, name: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(name) if isinstance(name, str) else name)


def _column(kind: str, name: Column | str, column: Column | str) -> Column:
    return F.concat(_id(kind, name), F.lit("|"), F.col(column) if isinstance(column, str) else column)


def _edge(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
    return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("edge_type"))


def fetched(stmts: DataFrame) -> DataFrame:
    """Host variables with the columns that FETCH and SELECT … INTO put there: program, seq, variable, sources, tables."""
    variable = lambda c: F.regexp_extract(c, r"([A-Z0-9-]+)$", 1)
    cur = J.paired(L.cursors(stmts), L.fetches(stmts), ["program", "cursor"])
    by_cursor = cur.select("program", F.lit(None).cast("int").alias("seq"), variable("variable").alias("variable"), L.source_columns(F.col("expr"), F.col("tables")).alias("sources"), "tables")
    s = stmts.where(F.col("stmt").rlike(r"^EXEC SQL SELECT\b.* INTO :"))
    parts = S.clauses(F.regexp_replace("stmt", r"^EXEC SQL (.*?)(?: END-EXEC.*)?$", "$1"), f"INTO|{L.CLAUSES}")
    s = s.select("program", "seq", parts.alias("parts"))
    one = s.select("program", "seq", L.table_aliases(L.clause("parts", "FROM")).alias("tables"), F.posexplode(F.arrays_zip(S.split_top(L.clause("parts", "SELECT")).alias("expr"), S.split_top(L.clause("parts", "INTO")).alias("into"))).alias("pos", "x"))
    one = one.select("program", "seq", F.regexp_extract("x.into", r"^:([A-Z0-9-]+\.)?([A-Z0-9-]+)", 2).alias("variable"), L.source_columns(F.col("x.expr"), F.col("tables")).alias("sources"), "tables")
    return by_cursor.unionByName(one.where("variable <> ''"))


def inserted(stmts: DataFrame) -> DataFrame:
    """Static embedded INSERT … VALUES: program, seq, table, column, variable, by position."""
    pattern = r"^EXEC SQL INSERT INTO ([A-Z0-9_.$#]+) ?\(([^()]*)\) ?VALUES ?\((.*)\)"
    g = lambda k: F.regexp_extract("stmt", pattern, k)
    t = stmts.where(F.col("stmt").rlike(pattern)).select("program", "seq", g(1).alias("table"), F.posexplode(F.arrays_zip(S.split_top(g(2)).alias("column"), S.split_top(g(3)).alias("value"))).alias("pos", "x"))
    return t.select("program", "seq", "table", F.col("x.column").alias("column"), F.regexp_extract("x.value", r"^:(?:[A-Z0-9-]+\.)?([A-Z0-9-]+)", 1).alias("variable"))


def bound_files(bindings: DataFrame, modes: DataFrame, dds: DataFrame) -> DataFrame:
    """Each program's files with their directions and names: of the dataset a job binds them to, or else logical: program, fd, direction, file."""
    dsn = dds.where("dsn is not null").select("program", "dd", "dsn").distinct()
    return bindings.join(modes, ["program", "file"]).join(dsn, ["program", "dd"], "left").select("program", F.col("file").alias("fd"), "direction", F.coalesce("dsn", F.concat_ws(".", "program", "file")).alias("file"))


def tso_gaps(steps: DataFrame) -> DataFrame:
    """Monitor steps whose program or SQL can't be read: no inline deck, no RUN in it, or data statements run by the dynamic SQL sample programs."""
    monitors = steps.where((F.col("op") == "EXEC") & F.col("program").isin(*L.MONITORS)).select("path", "job", "step", "line")
    deck = steps.where("name = 'SYSTSIN'").select("path", "step", F.upper(F.array_join("data", " ")).alias("deck"))
    both = monitors.join(deck, ["path", "step"], "left").withColumn("run", F.regexp_extract("deck", r"PROGRAM\s*\(\s*(\w+)\s*\)", 1))
    sysin = steps.where("name = 'SYSIN'").select("path", "step", F.upper(F.array_join("data", " ")).alias("sql"))
    both = both.join(sysin, ["path", "step"], "left")
    kind = F.when(F.coalesce("deck", F.lit("")) == "", "JCL_TSO_SYSTSIN").when(F.col("run") == "", "JCL_TSO_RUN").when(F.col("run").isin("DSNTEP2", "DSNTEP4") & F.col("sql").rlike(r"\b(INSERT|UPDATE|DELETE|MERGE)\b"), "JCL_TSO_SQL")
    return both.select(F.col("job").alias("program"), kind.alias("statement_type"), F.left(F.coalesce(F.when(F.col("run") != "", F.col("sql")).otherwise(F.col("deck")), "step"), F.lit(300)).alias("snippet"), F.col("path").alias("file"), "line").where("statement_type is not null")


def file_layouts(fields: DataFrame, files: DataFrame) -> DataFrame:
    """dsn, field, start, length of each dataset, from one program's record: a writer's before a reader's, by name."""
    owner = files.join(fields.where("valid").select("program", "fd").distinct(), ["program", "fd"]).groupBy(F.col("file").alias("dsn"))
    owner = owner.agg(F.min(F.struct((F.col("direction") == "READS_FROM").alias("reads"), "program", "fd")).alias("o")).select("dsn", "o.program", "o.fd")
    return fields.where("valid and field <> 'FILLER'").join(owner, ["program", "fd"]).select("dsn", "program", "field", "ord", "start", "length")


def statement_places(files: DataFrame, lines: DataFrame, stmts: DataFrame, sql: DataFrame) -> DataFrame:
    """path, program, seq, file, line: where every statement of programs (of ``lines``) and SQL files begins, through copybooks."""
    key = ["path", "program", "seq", "offset"]
    by_program = E.placed(stmts.select(*key), E.line_starts(lines))
    return by_program.unionByName(E.placed(sql.select(*key), E.text_line_starts(files.where("language = 'SQL'")))).drop("offset")


def build(files: DataFrame) -> Lineage:
    """The lineage of an estate; files: path, member, language, text as ``estate.files`` gives them."""
    lines = E.cobol_lines(files)
    progs = settled(E.programs(lines))
    stmts = settled(E.statements(progs))
    items = settled(L.data_items(progs))
    fields = settled(L.layouts(items))
    steps = settled(L.job_steps(E.substituted(E.job_statements(files))))
    dds = settled(L.dd_statements(steps))
    sql = settled(L.sql_statements(files))

    # programs: what each statement moves
    moves = settled(L.transforms(stmts).unionByName(L.reads_into(stmts, items)))
    grouped, group_gaps = L.group_moves(moves, fields)
    moved = settled(moves.unionByName(grouped).unionByName(L.conditional_sources(stmts, moves)))
    sites, passed, missing = L.call_sites(stmts, progs)
    sites, passed = settled(sites), settled(passed)
    host, into = settled(fetched(stmts)), settled(inserted(stmts))
    bound = settled(bound_files(L.file_bindings(progs), L.open_modes(stmts), dds))
    taken = moved.select("program", "seq").unionByName(host.where("seq is not null").select("program", "seq")).unionByName(into.select("program", "seq"))

    # where variables come from, and where they go
    record_fields = items.where("fd is not null and name <> 'FILLER'").select("program", "fd", "name", F.when(F.col("pic").isNull(), "*").otherwise(F.col("name")).alias("column"))
    in_file = bound.join(record_fields, ["program", "fd"])
    from_file = in_file.where("direction = 'READS_FROM'").select("program", F.col("name").alias("variable"), _column("FILE", "file", "column").alias("entity"))
    from_table = host.select("program", "variable", F.explode("sources").alias("s")).select("program", "variable", _id("TABLE", "s").alias("entity"))
    origins = settled(from_file.unionByName(from_table).distinct())
    to_file = in_file.where("direction = 'WRITES_TO' and column <> '*'").select("program", F.col("name").alias("variable"), _column("FILE", "file", "column").alias("entity"))
    to_table = into.where("variable <> ''").select("program", "variable", _column("TABLE", "table", "column").alias("entity"))
    outputs = settled(to_file.unionByName(to_table).distinct())

    contexts, links = L.call_contexts(progs.select("program").union(moved.select("program")), sites)
    contexts = settled(contexts)
    named = lambda df: df.join(contexts, "program").select(F.concat("program", F.lit("@"), "chain", F.lit("."), "variable").alias("name"), "program", "entity")
    all_steps = L.steps_in_context(moved.select("program", "target", "source", "logic").distinct(), sites, passed, (contexts, links))
    flows = L.traced(all_steps, named(outputs), named(origins))
    flows = flows.join(named(outputs).select(F.col("name").alias("output"), "program", F.col("entity").alias("target_id")), "output").join(named(origins).select(F.col("name").alias("origin"), F.col("entity").alias("source_id")), "origin")
    plain = (F.size("path") == 0) | ((F.size("path") == 1) & F.get("path", F.lit(0)).rlike("^(?:MOVE|READ) "))
    how = F.when(plain, "direct").otherwise(S.clipped(F.array_join("path", "; "), 600))
    # of a program's contexts and of several paths the shortest transformation stays
    columns = flows.where("source_id <> target_id").groupBy("source_id", "target_id", "program").agg(F.min_by(how, F.struct(F.size("path"), how)).alias("transformation"))
    columns = settled(columns)

    # SQL text
    declared = settled(L.table_columns(sql))
    traced, open_names = SC.scope_columns(sql, declared.groupBy("table", "column").agg(F.min("pos").alias("pos")))
    traced = settled(traced)
    sql_gaps = settled(SC.scope_unmapped(sql, traced, open_names))
    by_sql = traced.select(_id("TABLE", "source").alias("source_id"), _column("TABLE", "target", "target_column").alias("target_id"), "program", "transformation")
    located, positions = L.external_fields(sql)
    located = settled(located)

    # jobs: unloads, sorts, transfers
    layout = settled(file_layouts(fields, bound))
    unloaded = settled(L.unloads(dds))
    item = unloaded.select("program", "table", "dsn", L.table_aliases(F.col("table")).alias("tables"), F.explode("columns").alias("item"))
    alias = F.coalesce(F.nullif(F.regexp_extract("item", r" (?:AS )?([A-Z_][A-Z0-9_]*)$", 1), F.lit("")), F.nullif(F.regexp_extract("item", r"^(?:[A-Z0-9_]+\.)?([A-Z0-9_*]+)$", 1), F.lit("")), F.col("item"))
    source = F.when(F.col("item") == "*", F.array(F.concat("table", F.lit("|*")))).otherwise(L.source_columns(F.col("item"), F.col("tables")))
    by_unload = item.select("program", "dsn", alias.alias("column"), F.explode(source).alias("s"), F.when(F.col("item") == alias, "direct").otherwise(F.col("item")).alias("transformation")).select(_id("TABLE", "s").alias("source_id"), _column("FILE", "dsn", "column").alias("target_id"), "program", "transformation")
    readers = bound.where("direction = 'READS_FROM'").join(fields.where("valid and field <> 'FILLER'"), ["program", "fd"]).select(F.col("file").alias("dsn"), "program", "field", "ord", "start", "length")
    aliases, alias_gaps = L.unload_aliases(unloaded.where("not array_contains(columns, '*')"), readers)
    sorted_, sort_gaps = SS.sort_columns(dds, layout)
    by_sort = sorted_.select(_column("FILE", "source_dsn", "source").alias("source_id"), _column("FILE", "target_dsn", "target").alias("target_id"), "program", F.lit("direct").alias("transformation"))
    by_unload, by_sort = settled(by_unload), settled(by_sort)
    sent_edges, templates = L.transfers(steps)
    sent = settled(sent_edges)

    edges = L.job_edges(steps, dds).unionByName(L.linked_files(L.file_bindings(progs), L.open_modes(stmts), dds)).unionByName(L.sql_edges(sql)).unionByName(L.call_edges(sites)).unionByName(sent)
    edges = edges.unionByName(_edge(host.select("program", F.explode(F.array_distinct(F.map_values("tables"))).alias("t")), _id("TABLE", "t"), _id("PROGRAM", "program"), "READS_FROM"))
    edges = edges.unionByName(_edge(into, _id("PROGRAM", "program"), _id("TABLE", "table"), "WRITES_TO"))
    edges = edges.unionByName(_edge(unloaded, _id("TABLE", "table"), _id("PROGRAM", "program"), "READS_FROM"))
    loader = F.concat(F.lit("LOADER."), F.col("table"))
    edges = edges.unionByName(_edge(located, _id("FILE", "file"), _id("PROGRAM", loader), "READS_FROM")).unionByName(_edge(located, _id("PROGRAM", loader), _id("TABLE", "table"), "WRITES_TO"))

    # remote names with symbols become the one file that they match, and carry the fields of what was sent
    names = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).where("id like 'FILE:%' and id not like '%*%'").select(F.substring("id", 6, 1 << 20).alias("name")).distinct()
    upper = names.unionByName(located.select(F.col("file").alias("name"))).distinct()
    absorbed = settled(J.unique_matches(upper, templates.select(F.upper("template").alias("template")).distinct())).select(_id("FILE", "template").alias("old"), _id("FILE", "name").alias("new"))
    edges = settled(G.absorb(edges.select(F.when(F.col("source_id").like("FILE:%"), F.upper("source_id")).otherwise(F.col("source_id")).alias("source_id"), F.when(F.col("target_id").like("FILE:%"), F.upper("target_id")).otherwise(F.col("target_id")).alias("target_id"), "edge_type"), absorbed))
    ftp = edges.where("edge_type = 'READS_FROM' and target_id like 'PROGRAM:FTP.%'").select(F.col("source_id").alias("sent"), F.col("target_id").alias("ftp"))
    ftp = settled(ftp.join(sent.where("source_id like 'PROGRAM:FTP.%'").select(F.col("source_id").alias("ftp"), F.upper("target_id").alias("old")), "ftp").join(templates.select(F.upper(_id("FILE", "template")).alias("old"), _id("FILE", "dsn").alias("by_template")).distinct(), "old", "left").where("by_template is null or by_template = sent").join(absorbed, "old", "left").select("sent", "ftp", F.coalesce("new", "old").alias("remote")))
    ours = by_sort.unionByName(columns).unionByName(by_unload)
    held = layout.select(_id("FILE", "dsn").alias("sent"), F.col("field").alias("column")).unionByName(ours.where("target_id like 'FILE:%'").select(G.owner(F.col("target_id")).alias("sent"), F.regexp_extract("target_id", r"\|([^|]*)$", 1).alias("column"))).distinct()
    by_transfer = ftp.join(held, "sent").select(F.concat_ws("|", "sent", "column").alias("source_id"), F.concat_ws("|", "remote", "column").alias("target_id"), F.regexp_replace("ftp", "^PROGRAM:", "").alias("program"), F.lit("direct").alias("transformation"))

    # external tables: fields of the file by byte position where its layout is known, or else by the table's own names
    origin = ftp.select(F.col("sent").alias("s_"), F.upper("remote").alias("remote_"))
    ext = located.select("program", "table", F.upper(_id("FILE", "file")).alias("remote_"), "format")
    known = layout.select(_id("FILE", "dsn").alias("s_"), "field", "start", (F.col("start") + F.col("length") - 1).alias("end")).join(origin, "s_")
    by_bytes = positions.select("table", "pos", F.col("field").alias("own"), F.col("start").alias("lo"), F.col("end").alias("hi")).join(ext, "table").join(known, "remote_", "left").where("s_ is null or (start <= hi and end >= lo)")
    column_at = declared.select("table", "pos", "column")
    by_bytes = by_bytes.join(column_at, ["table", "pos"]).select("table", "remote_", F.coalesce("field", "own").alias("field"), "column")
    by_name = ext.where("format <> 'POSITIONAL'").join(declared.select("table", "column"), "table").select("table", "remote_", F.col("column").alias("field"), "column")
    by_external = by_bytes.unionByName(by_name)
    by_external = settled(by_external).select(F.concat_ws("|", "remote_", "field").alias("source_id"), _column("TABLE", "table", "column").alias("target_id"), F.concat(F.lit("LOADER."), "table").alias("program"), F.lit("direct").alias("transformation"))

    column_edges = ours.unionByName(by_sql).unionByName(by_transfer).unionByName(by_external)
    # a reader's names of unloaded fields become the columns that were unloaded
    renamed = aliases.select(_column("FILE", "dsn", "field").alias("source_id"), _column("FILE", "dsn", "column").alias("canonical")).distinct()
    column_edges = settled(column_edges.join(renamed, "source_id", "left").select(F.coalesce("canonical", "source_id").alias("source_id"), "target_id", "program", "transformation").where("source_id <> target_id").distinct())

    # entities: their columns from column edges and declarations
    told = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).unionByName(progs.select(_id("PROGRAM", "program").alias("id"))).unionByName(declared.select(_id("TABLE", "table").alias("id")))
    mentions = told.select("id", F.lit(None).cast("string").alias("column")).unionByName(declared.select(_id("TABLE", "table").alias("id"), "column")).unionByName(layout.select(_id("FILE", "dsn").alias("id"), F.col("field").alias("column")))
    ends = column_edges.select(F.explode(F.array("source_id", "target_id")).alias("c")).select(G.owner(F.col("c")).alias("id"), F.regexp_extract("c", r"\|([^|]*)$", 1).alias("column"))
    columned = mentions.unionByName(ends).groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("column") != "*", F.col("column")))).alias("columns"))
    origin = progs.select(_id("PROGRAM", "program").alias("id"), F.lit("COBOL").alias("language"), "path").unionByName(sql.select(_id("PROGRAM", "program").alias("id"), F.lit("SQL").alias("language"), "path")).unionByName(steps.where("op = 'JOB'").select(_id("JOB", "job").alias("id"), F.lit("JCL").alias("language"), "path"))
    origin = origin.groupBy("id").agg(F.min("language").alias("language"), F.min("path").alias("path"))
    nodes = columned.join(origin, "id", "left").select("id", G.node_kind(F.col("id")).alias("kind"), F.regexp_replace("id", "^[A-Z]+:", "").alias("name"), "language", "path", "columns")

    places = settled(statement_places(files, lines, stmts, sql))
    # facts of programs carry no path; of two programs of one name the first place by path is told
    by_name = places.groupBy("program", "seq").agg(F.min(F.struct("path", "file", "line")).alias("p")).select("program", "seq", "p.file", "p.line")
    no_place = sql.where(F.col("stmt").rlike(r"\bORGANIZATION EXTERNAL\b")).join(located.select("program", "seq").distinct(), ["program", "seq"], "left_anti").select("path", "program", "seq", F.lit("SQL_DML_UNMAPPED").alias("statement_type"), S.clipped(F.col("stmt"), 300).alias("snippet"))
    cols = ["program", "statement_type", "snippet", "file", "line"]
    unparsed = no_place.unionByName(sql_gaps.select(*no_place.columns)).join(places, ["path", "program", "seq"], "left").select(*cols)
    for gaps in (L.cobol_gaps(stmts, taken), group_gaps, missing):
        unparsed = unparsed.unionByName(gaps.join(by_name, ["program", "seq"], "left").select(*cols))
    for gaps in (L.job_gaps(steps), tso_gaps(steps), E.copy_gaps(lines)):
        unparsed = unparsed.unionByName(gaps.select(*cols))
    for gaps in (alias_gaps, sort_gaps):
        unparsed = unparsed.unionByName(gaps.select(*cols[:3], F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line")))
    return Lineage(settled(nodes), edges, column_edges, settled(L.dynamic_constructs(stmts, sql)), settled(unparsed))
