"""Source estates as tables: files, code lines, copybooks, job statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.functions import scalars as S
from weftline.session import settled

#: Language by file suffix.
LANGUAGES = {"cbl": "COBOL", "cob": "COBOL", "cpy": "COPYBOOK", "jcl": "JCL", "sql": "SQL", "pls": "SQL", "prc": "SQL"}


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, member, language, text of every source file below a folder; other suffixes are left out."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    suffix = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    named = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    out = raw.select("path", F.upper(F.regexp_extract("path", r"([^/]+)\.\w+$", 1)).alias("member"), F.element_at(named, suffix).alias("language"), "text")
    return out.where("language is not null")


def _numbered(f: DataFrame) -> DataFrame:
    return f.select("path", "member", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw")).withColumn("line", F.col("line") + 1)


#: One part of a REPLACING list, of pseudo-text or of words, and how a continued COPY goes on.
PAIR = r"(==[^=]*==|[\w-]+) BY (==[^=]*==|[\w-]+)"
GOES_ON = r"(?i)^\s*(?:REPLACING|BY|OF|IN|SUPPRESS|LEADING|TRAILING|==|[.]|[\w-]+\s+BY\b)"


def _replaced(code: Column, pairs: Column) -> Column:
    """A copied line under the pairs of a REPLACING list, in their order; text that begins or ends in a word's letter meets whole words only."""
    bare = lambda x: F.trim(F.regexp_replace(x, "^==|==$", ""))
    quoted = lambda x: F.regexp_replace(x, r"([^\w\s-])", r"\\$1")
    edge = lambda x, at, guard: F.when(x.rlike(at), F.lit(guard)).otherwise(F.lit(""))

    def put(acc, p):
        old, new = bare(F.regexp_extract(p, PAIR, 1)), bare(F.regexp_extract(p, PAIR, 2))
        pattern = F.concat(F.lit("(?i)"), edge(old, r"^[\w-]", r"(?<![\w-])"), F.regexp_replace(quoted(old), r"\s+", r"\\s+"), edge(old, r"[\w-]$", r"(?![\w-])"))
        return F.when(old == "", acc).otherwise(F.regexp_replace(acc, pattern, F.regexp_replace(new, r"([\\$])", r"\\$1")))

    return F.aggregate(pairs, code, put)


def _copies_joined(code: DataFrame) -> DataFrame:
    """Lines of a file with each COPY statement on its first line: one that has not ended takes the lines that go on with it."""
    order = W.Window.partitionBy("path").orderBy("line")
    upto = W.Window.partitionBy("path", "copy_").orderBy("line")
    before = upto.rowsBetween(W.Window.unboundedPreceding, -1)
    marks = lambda c: F.regexp_count(c, F.lit("=="))
    t = code.withColumn("copy_", F.sum(F.col("code").rlike(r"(?i)^\s*COPY\s+[\w-]").cast("int")).over(order))
    t = t.withColumn("ends_", F.coalesce(F.sum(F.col("code").rlike(r"[.]\s*$").cast("int")).over(before), F.lit(0)) > 0)
    t = t.withColumn("inside_", F.coalesce(F.sum(marks("code")).over(before), F.lit(0)) % 2 == 1)
    t = t.withColumn("head_", F.min("line").over(upto))
    t = t.withColumn("own_", (F.col("copy_") > 0) & ~F.col("ends_") & ((F.col("line") == F.col("head_")) | F.col("inside_") | F.col("code").rlike(GOES_ON)))
    t = t.withColumn("own_", F.col("own_") & (F.coalesce(F.sum((~F.col("own_")).cast("int")).over(before), F.lit(0)) == 0))
    head = F.when(F.col("own_"), F.col("head_")).otherwise(F.col("line"))
    joined = t.groupBy("path", "member", head.alias("line")).agg(F.array_sort(F.collect_list(F.struct(F.col("line").alias("at"), "code"))).alias("parts_"))
    return joined.select("path", "member", "line", F.array_join(F.transform("parts_", lambda x: x["code"]), " ").alias("code"))


def cobol_lines(f: DataFrame) -> DataFrame:
    """Columns 8 to 72 of the lines that are long enough and no comments, COPY members laid in, to any depth.

    Returns path, member, line (of the program), sub (lines within copybooks), code, whence and at (the file that the
    line stands in, and its number there), stuck. Of copybooks with one name the nearest is taken: of the same folder,
    of one below it, of a folder beside it, or else the first by path. A COPY whose book isn't there, or that would
    copy a book into itself, stays as a line that ``stuck`` tells apart (missing, cycle). A COPY may take several
    lines; its REPLACING list holds for the lines of its own book. A round lays in the books of the last round's COPY
    lines only; a line's books are distinct, so there are at most as many rounds as books.
    """
    def code_of(df: DataFrame) -> DataFrame:
        return _copies_joined(_numbered(df).where((F.length("raw") >= 7) & ~F.substring("raw", 7, 1).isin("*", "/")).select("path", "member", "line", F.substring("raw", 8, 65).alias("code")))

    folder = lambda c: F.regexp_extract(c, r"^(.*/)[^/]*$", 1)
    copied = F.upper(F.regexp_extract("code", r"(?i)^\s*COPY\s+([\w-]+)", 1))
    pairs = F.regexp_extract_all(F.regexp_replace(F.regexp_extract("code", r"(?is)\bREPLACING\s+(.*)$", 1), r"\s+", " "), F.lit(f"(?i)({PAIR})"), F.lit(1))
    books = settled(code_of(f.where("language = 'COPYBOOK'")).groupBy(F.col("member").alias("copied"), F.col("path").alias("book")).agg(F.array_sort(F.collect_list(F.struct("line", "code"))).alias("body")))
    # the first book of a name in a folder, and in it or below it; "" stands for all folders
    theirs = folder(F.col("book"))
    parts = F.split(theirs, "/")
    within = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    by_folder = books.select("copied", "book", theirs.alias("theirs"), F.explode(within).alias("folder")).groupBy("copied", "folder").agg(F.min(F.when(F.col("theirs") == F.col("folder"), F.col("book"))).alias("same"), F.min("book").alias("below"))
    by_folder = settled(by_folder)
    anywhere = by_folder.where("folder = ''").select("copied", F.col("below").alias("any"))
    level = code_of(f.where("language = 'COBOL'")).withColumns({"sub": F.array(F.lit(0)), "whence": F.col("path"), "at": F.col("line"), "books": F.array().cast("array<string>")})
    out, cols = None, ["path", "member", "line", "sub", "code", "whence", "at", "stuck"]
    while True:
        level = settled(level.withColumns({"copied": F.nullif(copied, F.lit("")), "pairs": pairs}))
        plain = level.where("copied is null").withColumn("stuck", F.lit(None).cast("string")).select(*cols)
        out = plain if out is None else out.unionByName(plain)
        if level.where("copied is not null").isEmpty():
            return out
        copies = level.where("copied is not null")
        # by the folders to look in, nearest first, so that a name that many folders have is never met pair by pair
        wanted = copies.select("whence", "copied").distinct().withColumn("own", folder(F.col("whence")))
        looks = F.array(F.struct(F.lit(0).alias("near"), F.col("own").alias("folder")), F.struct(F.lit(2).alias("near"), F.regexp_extract("own", "^(.*/)[^/]*/$", 1).alias("folder")))
        hits = wanted.select("whence", "copied", F.explode(looks).alias("l")).select("whence", "copied", "l.*").join(by_folder, ["copied", "folder"])
        hits = hits.groupBy("whence", "copied").agg(F.min(F.when(F.col("near") == 0, F.col("same"))).alias("same"), F.min(F.when(F.col("near") == 0, F.col("below"))).alias("below"), F.min(F.when(F.col("near") == 2, F.col("below"))).alias("beside"))
        chosen = wanted.join(hits, ["whence", "copied"], "left").join(anywhere, "copied").select("whence", "copied", F.coalesce("same", "below", "beside", "any").alias("book"))
        met = copies.join(chosen, ["whence", "copied"], "left").withColumn("stuck", F.when(F.col("book").isNull(), "missing").when(F.array_contains("books", F.col("book")), "cycle"))
        out = out.unionByName(met.where("stuck is not null").select(*cols))
        laid = met.where("stuck is null").join(books, ["copied", "book"]).withColumn("part", F.explode("body"))
        level = laid.select("path", "member", "line", F.concat("sub", F.array("part.line")).alias("sub"), _replaced(F.col("part.code"), F.col("pairs")).alias("code"), F.col("book").alias("whence"), F.col("part.line").alias("at"), F.concat("books", F.array("book")).alias("books"))


def copy_gaps(lines: DataFrame) -> DataFrame:
    """COPY lines that stayed, for the report: program (the member), statement_type, snippet, file, line."""
    return lines.where("stuck is not null").select(F.col("member").alias("program"), F.lit("COBOL_COPY").alias("statement_type"), F.concat(F.left(F.trim(F.regexp_replace("code", r"\s+", " ")), F.lit(280)), F.lit(": "), "stuck").alias("snippet"), F.col("whence").alias("file"), F.col("at").alias("line"))


def guarded(text: Column) -> Column:
    """Quoted literals with what could be taken for an end or a separator turned into private characters, which ``clipped`` turns back."""
    pieces = F.regexp_extract_all(text, F.lit(f"({S.LITERAL}|[^'\"]++|['\"])"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^['\"]"), F.translate(p, S.GUARD, S.GUARDED)).otherwise(p)), "")


def without_comments(text: Column) -> Column:
    """SQL text with comments blanked, its literals guarded, every offset kept: both are found in one pass, so neither hides in the other."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/|{S.LITERAL}|[^'\"/-]++|.)"), F.lit(1))
    kept = lambda p: F.when(p.startswith("--") | p.startswith("/*"), F.regexp_replace(p, r"[^\n]", " ")).when(p.rlike("^['\"]"), F.translate(p, S.GUARD, S.GUARDED)).otherwise(p)
    return F.array_join(F.transform(pieces, kept), "")


def programs(lines: DataFrame) -> DataFrame:
    """One row for each program: path, program, data (its divisions before the procedures), procedures, begins (their offset in the text), parameters."""
    whole = lines.groupBy("path", "member").agg(F.array_sort(F.collect_list(F.struct("line", "sub", "code"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["code"]), "\n")
    t = whole.select("path", "member", guarded(text).alias("text"))
    named = F.upper(F.regexp_extract("text", r"(?i)PROGRAM-ID\.\s*([\w-]+)", 1))
    cut = F.regexp_instr("text", F.lit(r"(?i)PROCEDURE\s+DIVISION"))
    return t.select(
        "path",
        F.when(named == "", F.col("member")).otherwise(named).alias("program"),
        F.when(cut > 0, F.substring(F.col("text"), F.lit(1), cut - 1)).otherwise(F.col("text")).alias("data"),
        F.when(cut > 0, F.substring(F.col("text"), cut, F.length("text"))).otherwise(F.lit("")).alias("procedures"),
        F.greatest(cut - 1, F.lit(0)).alias("begins"),
    ).withColumn("parameters", F.regexp_extract_all(F.upper(F.regexp_extract("procedures", r"(?i)^PROCEDURE\s+DIVISION\s+USING\s+([^.]*)\.", 1)), F.lit(r"([A-Z][A-Z0-9-]*)"), F.lit(1)))


#: Words that begin a statement.
VERBS = "MOVE COMPUTE STRING UNSTRING ADD SUBTRACT MULTIPLY DIVIDE READ WRITE REWRITE OPEN CLOSE CALL EVALUATE WHEN END-EVALUATE IF ELSE END-IF PERFORM END-PERFORM SEARCH END-SEARCH EXEC DISPLAY ACCEPT INSPECT INITIALIZE SET GOBACK STOP EXIT AT".split()


def statements(progs: DataFrame) -> DataFrame:
    """Statements of each program in order: path, program, seq, sentence, offset (in the program's text), verb, stmt (upper case, one blank between words).

    Sentences, which end at a period, are numbered; words in literals are guarded already.
    """
    verbs = "|".join(VERBS)
    # embedded SQL is kept whole by hiding its words' boundaries behind a mark
    sql = F.regexp_extract_all("procedures", F.lit(r"(?is)(EXEC\s+(?:SQL|CICS).*?END-EXEC\.?|(?:(?!EXEC\s+(?:SQL|CICS)).)++)"), F.lit(1))
    pieces = F.flatten(F.transform(sql, lambda p: F.when(p.rlike(r"(?is)^EXEC\s"), F.array(p)).otherwise(F.split(F.regexp_replace(p, rf"(?i)(?<=[\s.])({verbs})(?=[\s.])", "\u0001$1"), "\u0001"))))
    each = progs.select("path", "program", "begins", F.posexplode(pieces).alias("seq", "raw"))
    stmt = F.upper(F.trim(F.regexp_replace(F.regexp_replace("raw", r"\s+", " "), r"\.(\s.*)?$", "")))
    ends = F.col("raw").rlike(r"\.(\s|$)").cast("int")
    before = W.Window.partitionBy("path", "program").orderBy("seq").rowsBetween(W.Window.unboundedPreceding, -1)
    out = each.select("path", "program", "seq", F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("int").alias("sentence"), (F.col("begins") + F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)) + F.length("raw") - F.length(F.ltrim(F.translate("raw", "\n\t", "  ")))).alias("offset"), stmt.alias("stmt"))
    return out.withColumn("verb", F.substring_index("stmt", " ", 1)).where("stmt <> ''")


def placed(stmts: DataFrame, starts: DataFrame) -> DataFrame:
    """Statements (path, offset, …) with the file and line they begin in: of the last line that starts at or before them.

    starts: path, start, file, line (``line_starts`` of programs, ``text_line_starts`` of plain text). Both are laid in one
    order by offset, so it takes one shuffle by path and no join of ranges.
    """
    at = F.struct("file", "line")
    cols = stmts.columns
    both = stmts.select(F.col("path"), F.col("offset").alias("at_"), F.lit(1).alias("kind_"), F.struct(*cols).alias("s_"), F.lit(None).cast(starts.select(at.alias("x")).schema["x"].dataType).alias("l_"))
    both = both.unionByName(starts.select("path", F.col("start").alias("at_"), F.lit(0).alias("kind_"), F.lit(None).cast(both.schema["s_"].dataType).alias("s_"), at.alias("l_")))
    last = F.last("l_", ignorenulls=True).over(W.Window.partitionBy("path").orderBy("at_", "kind_"))
    return both.select("s_", last.alias("l_")).where("s_ is not null").select("s_.*", "l_.file", "l_.line")


def line_starts(lines: DataFrame) -> DataFrame:
    """path, start, file, line: where each line that ``programs`` puts together begins in the text, and where it comes from."""
    before = W.Window.partitionBy("path").orderBy("line", "sub").rowsBetween(W.Window.unboundedPreceding, -1)
    return lines.select("path", F.coalesce(F.sum(F.length("code") + 1).over(before), F.lit(0)).alias("start"), F.col("whence").alias("file"), F.col("at").alias("line"))


def text_line_starts(f: DataFrame) -> DataFrame:
    """path, start, file, line of every line of a text, at whose ends a carriage return counts as part of the line."""
    each = f.select("path", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    before = W.Window.partitionBy("path").orderBy("n").rowsBetween(W.Window.unboundedPreceding, -1)
    return each.select("path", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).alias("start"), F.col("path").alias("file"), (F.col("n") + 1).alias("line"))


def job_statements(f: DataFrame) -> DataFrame:
    """Job statements with continuations joined and inline data attached: path, line, name, op, operands, data.

    Running sums tell which lines a statement takes: a card begins a new one unless the card
    before it ended in a comma; lines without slashes are data of the statement before.
    """
    ls = _numbered(f.where("language = 'JCL'")).where("not raw like '//*%' and trim(raw) not in ('', '/*', '//')")
    order = W.Window.partitionBy("path").orderBy("line")
    card = F.col("raw").startswith("//")
    body = F.rtrim(F.substring("raw", 3, 70))
    marked = ls.withColumns({"card": card, "body": F.when(card, body).otherwise(F.rtrim("raw"))})
    open_ = F.lag(F.col("card") & F.col("body").endswith(","), 1, False).over(order)
    marked = marked.withColumn("starts", F.col("card") & ~open_)
    grouped = marked.withColumn("stmt", F.sum(F.col("starts").cast("int")).over(order)).where("stmt > 0")
    parts = grouped.groupBy("path", "stmt").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "card", "body"))).alias("ls"))
    cards = F.filter("ls", lambda x: x["card"])
    joined = F.array_join(F.transform(cards, lambda x, k: F.when(k == 0, x["body"]).otherwise(F.trim(x["body"]))), "")
    data = F.transform(F.filter("ls", lambda x: ~x["card"]), lambda x: x["body"])
    t = parts.select("path", "line", joined.alias("text"), data.alias("data"))
    pick = lambda k: F.regexp_extract("text", r"^(\S*)\s+(\S+)\s*(.*)$", k)
    return t.select("path", "line", pick(1).alias("name"), pick(2).alias("op"), pick(3).alias("operands"), "data")


def substituted(stmts: DataFrame) -> DataFrame:
    """Operands with ``&NAME`` symbols replaced by what the SET statements before them (by ``line``) have made of them.

    A symbol's value is settled where it is set, from the symbols before it; so there are no
    cycles, and a name that is not set yet stays.
    """
    pairs = F.transform(F.regexp_extract_all("operands", F.lit(r"(\w+=[^,\s]+)"), F.lit(1)), lambda kv: F.struct(F.substring_index(kv, "=", 1).alias("k"), F.substring(kv, F.instr(kv, "=") + 1, F.length(kv)).alias("v")))
    sets = stmts.where("op = 'SET'").select("path", "line", F.posexplode(pairs).alias("at", "kv")).select("path", F.struct("line", "at", "kv.k", "kv.v").alias("s"))
    symbols = sets.groupBy("path").agg(F.array_sort(F.collect_list("s")).alias("symbols"))
    kind = "array<struct<n:int,k:string,v:string>>"

    def put(text, known):
        """Longest names first, so that no name is taken for the beginning of another."""
        return F.aggregate(F.array_sort(known), text, lambda acc, s: F.replace(F.replace(acc, F.concat(F.lit("&"), s["k"], F.lit(".")), s["v"]), F.concat(F.lit("&"), s["k"]), s["v"]))

    def learn(known, s):
        others = F.filter(known, lambda x: x["k"] != s["k"])
        return F.concat(others, F.array(F.struct((-F.length(s["k"])).alias("n"), s["k"].alias("k"), put(s["v"], known).alias("v")))).cast(kind)

    out = stmts.join(symbols, "path", "left")
    before = F.filter(F.coalesce("symbols", F.array().cast("array<struct<line:int,at:int,k:string,v:string>>")), lambda s: s["line"] < F.col("line"))
    known = F.aggregate(before, F.array().cast(kind), learn)
    return out.withColumn("known", known).withColumn("operands", put(F.col("operands"), F.col("known"))).drop("symbols", "known")
