"""Column lineage of sort steps: their control cards as byte maps from input to output records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Programs whose control cards are sort cards, and a record's greatest length.
SORTS = ("SORT", "DFSORT", "SYNCSORT", "ICEMAN")
LONGEST = 32760
#: An item of a list: a column to go to, a range of bytes (of a joined file), a literal, blanks or zeros.
ITEM = r"(\d+:(?=[\dCXZF])|(?:F[12]:)?\d+,\d+|\d*C'[^']*'|\d*[XZ](?![A-Z]))"
PIECE = "array<struct<out:int,tag:string,src:int,len:int>>"


def byte_map(items):
    """Ranges of a list, with the place that each takes in the record it builds: out, tag (file of a join), src, len."""
    number = lambda x, k: F.regexp_extract(x, k, 1).try_cast("int")

    def step(acc, x):
        spread = F.coalesce(F.nullif(F.regexp_extract(x, r"^(\d+)[CXZ]", 1), F.lit("")).try_cast("int"), F.lit(1))
        size = F.when(x.rlike(r",\d+$"), number(x, r",(\d+)$")).when(x.rlike("C'"), spread * F.length(F.regexp_extract(x, "C'([^']*)'", 1))).otherwise(spread)
        piece = F.struct(acc["at"].alias("out"), F.coalesce(F.nullif(F.regexp_extract(x, "^(F[12]):", 1), F.lit("")), F.lit("F0")).alias("tag"), number(x, r"(\d+),\d+$").alias("src"), size.alias("len"))
        pieces = F.when(x.rlike(r",\d+$"), F.concat(acc["pieces"], F.array(piece).cast(PIECE))).otherwise(acc["pieces"])
        at = F.when(x.rlike(r"^\d+:$"), number(x, r"^(\d+):")).otherwise(acc["at"] + size)
        return F.struct(at.cast("int").alias("at"), pieces.alias("pieces"))

    zero = F.struct(F.lit(1).alias("at"), F.array().cast(PIECE).alias("pieces"))
    return F.aggregate(items, zero, step)["pieces"]


def sort_cards(dds: DataFrame) -> DataFrame:
    """program, pos, card, operands of sort control decks, continued cards joined."""
    deck = dds.where(F.col("dd").isin("SYSIN", "TOOLIN") & F.substring_index("program", ".", 1).isin(*SORTS, "ICETOOL"))
    text = F.regexp_replace(F.array_join(F.filter(F.transform("data", lambda x: F.trim(x)), lambda x: ~x.startswith("*")), "\n"), r",\n", ",")
    t = deck.select("program", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return t.select("program", "pos", F.upper(F.regexp_extract("line", r"^(\w+)", 1)).alias("card"), F.trim(F.regexp_replace("line", r"^\w+", "")).alias("operands")).where("card <> ''")


def _listed(name: str):
    """Content of NAME=( … ), literals and one level of parentheses inside it included."""
    return F.regexp_extract("operands", rf"\b(?:{name})=\(((?:[^()']|'[^']*'|\([^()]*\))*)\)", 1)


def build_items(cards: DataFrame) -> DataFrame:
    """program, pos, card, out, tag, src, len: byte ranges of BUILD, OUTREC and REFORMAT lists, and where they go."""
    t = cards.where(F.col("card").isin("OUTFIL", "INREC", "OUTREC", "REFORMAT"))
    content = F.when(F.col("card") == "OUTFIL", _listed("BUILD|OUTREC")).otherwise(_listed("BUILD|FIELDS"))
    t = t.select("program", "pos", "card", F.explode(byte_map(F.regexp_extract_all(content, F.lit(ITEM), F.lit(1)))).alias("i"))
    return t.select("program", "pos", "card", "i.*")


def composed(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Byte maps of one program laid over each other: program, out, tag, src, len of what ``outer`` takes of what ``inner`` builds."""
    o = outer.select("program", F.col("out").alias("o_out"), F.col("src").alias("o_src"), F.col("len").alias("o_len"))
    i = inner.select("program", "tag", F.col("out").alias("i_out"), F.col("src").alias("i_src"), F.col("len").alias("i_len"))
    lo, hi = F.greatest("o_src", "i_out"), F.least(F.col("o_src") + F.col("o_len"), F.col("i_out") + F.col("i_len"))
    return o.join(i, "program").where(lo < hi).select("program", (F.col("o_out") + lo - F.col("o_src")).alias("out"), "tag", (F.col("i_src") + lo - F.col("i_out")).alias("src"), (hi - lo).alias("len"))


def sort_columns(dds: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Column edges of sort steps (program, source_dsn, source, target_dsn, target), and steps without any for the report.

    fields: dsn, field, start, length. The record goes through REFORMAT, INREC, OUTREC and each
    OUTFIL; an output without a known layout takes the input's field names.
    """
    steps = dds.where(F.substring_index("program", ".", 1).isin(*SORTS))
    programs = steps.select("program").distinct()
    cards = sort_cards(dds).where(F.substring_index("program", ".", 1).isin(*SORTS))
    items = build_items(cards)
    whole = lambda p: p.select("program", F.lit(1).alias("out"), F.lit("F0").alias("tag"), F.lit(1).alias("src"), F.lit(LONGEST).alias("len"))
    record = items.where("card = 'REFORMAT'").select("program", "out", "tag", "src", "len")
    record = record.unionByName(whole(programs.join(record.select("program").distinct(), "program", "left_anti")))
    for card in ("INREC", "OUTREC"):
        own = items.where(F.col("card") == card)
        with_card = own.select("program").distinct()
        record = composed(own, record).unionByName(record.join(with_card, "program", "left_anti"))

    # outputs: each OUTFIL by its names, with its own list or the record as it is; without OUTFIL, SORTOUT
    named = F.when(_listed("FNAMES") != "", _listed("FNAMES")).otherwise(F.regexp_extract("operands", r"\bFNAMES=([A-Z0-9$#@]+)", 1))
    outfil = cards.where("card = 'OUTFIL'").select("program", "pos", F.explode(F.split(F.when(named == "", "SORTOUT").otherwise(named), ",")).alias("dd"))
    outs = outfil.unionByName(programs.join(outfil.select("program").distinct(), "program", "left_anti").select("program", F.lit(-1).alias("pos"), F.lit("SORTOUT").alias("dd")))
    key = F.concat_ws("|", "program", "pos")
    built = items.where("card = 'OUTFIL'").withColumn("program", key)
    all_ = record.join(outs.select("program", "pos").distinct(), "program").withColumn("program", key).select("program", "out", "tag", "src", "len")
    listed = built.select("program").distinct()
    final = composed(built, all_).unionByName(all_.join(listed, "program", "left_anti"))
    final = final.select(F.substring_index("program", "|", 1).alias("program"), F.substring_index("program", "|", -1).cast("int").alias("pos"), "out", "tag", "src", "len")

    # the joined files' DDs: F1=NAME on JOINKEYS, or the usual names
    tags = cards.where("card = 'JOINKEYS'").select("program", F.regexp_extract("operands", r"\b(F[12])=", 1).alias("tag"), F.regexp_extract("operands", r"\bF[12]=([A-Z0-9$#@]+)", 1).alias("dd")).where("tag <> ''")
    usual = programs.crossJoin(cards.sparkSession.createDataFrame([("F0", "SORTIN"), ("F1", "SORTJNF1"), ("F2", "SORTJNF2")], "tag string, dd string"))  # three rows a step
    tags = tags.unionByName(usual.join(tags.select("program", "tag"), ["program", "tag"], "left_anti"))
    files = steps.where("dsn is not null").select("program", "dd", "dsn")
    source = tags.join(files, ["program", "dd"]).select("program", "tag", F.col("dsn").alias("source_dsn"))
    target = outs.join(files, ["program", "dd"]).select("program", "pos", F.col("dsn").alias("target_dsn"))
    layout = lambda side: fields.select(F.col("dsn").alias(f"{side}_dsn"), F.col("field").alias(side), F.col("start").alias(f"{side}_start"), F.col("length").alias(f"{side}_length"))
    met = final.join(source, ["program", "tag"]).join(layout("source"), "source_dsn").where("source_start < src + len and source_start + source_length > src").join(target, ["program", "pos"])
    at = F.greatest("source_start", "src") + F.col("out") - F.col("src")
    met = met.withColumns({"lo": at, "hi": at + F.least(F.col("source_start") + F.col("source_length"), F.col("src") + F.col("len")) - F.greatest("source_start", "src")})
    known = fields.select(F.col("dsn").alias("target_dsn")).distinct()
    named_ = met.join(layout("target"), "target_dsn").where("target_start < hi and target_start + target_length > lo")
    plain = met.join(known, "target_dsn", "left_anti").withColumn("target", F.col("source"))
    cols = ["program", "source_dsn", "source", "target_dsn", "target"]
    out = named_.select(*cols).unionByName(plain.select(*cols)).distinct()
    deck = cards.groupBy("program").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "card", "operands"))), lambda c: F.concat_ws(" ", c["card"], c["operands"])), "; ").alias("snippet"))
    gaps = programs.join(out.select("program").distinct(), "program", "left_anti").join(deck, "program", "left")
    return out, gaps.select("program", F.lit("JCL_SORT_CONTROL").alias("statement_type"), F.left(F.coalesce("snippet", F.lit("")), F.lit(300)).alias("snippet"))


def sort_keys(cards: DataFrame) -> DataFrame:
    """program, card, tag, pos, start, length, order of SORT, MERGE and JOINKEYS keys."""
    t = cards.where(F.col("card").isin("SORT", "MERGE", "JOINKEYS"))
    tag = F.coalesce(F.nullif(F.regexp_extract("operands", r"\b(F[12])=", 1), F.lit("")), F.nullif(F.regexp_extract("operands", r"\bFILES?=(F[12])", 1), F.lit("")), F.lit("F0"))
    each = t.select("program", "card", tag.alias("tag"), F.posexplode(F.regexp_extract_all(_listed("FIELDS"), F.lit(r"(\d+,\d+(?:,[A-Z]{2})?,[AD])"), F.lit(1))).alias("pos", "x"))
    return each.select("program", "card", "tag", "pos", F.regexp_extract("x", r"^(\d+)", 1).cast("int").alias("start"), F.regexp_extract("x", r"^\d+,(\d+)", 1).cast("int").alias("length"), F.regexp_extract("x", "([AD])$", 1).alias("order"))
