"""Join operators: sort-utility joins, ranges, patterns, positions, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.session import settled

#: JOIN cards of a sort step and the join they mean.
MODES = {"": "inner", "UNPAIRED,F1": "left", "UNPAIRED,F2": "right", "UNPAIRED": "full", "UNPAIRED,F1,F2": "full", "UNPAIRED,F1,ONLY": "left_anti", "UNPAIRED,F2,ONLY": "right_anti"}


def joinkeys(f1: DataFrame, f2: DataFrame, keys: list[str], card: str = "") -> DataFrame:
    """Join two files on keys of the same name, in the mode that the JOIN card states."""
    mode = MODES[card.replace(" ", "").upper()]
    if mode == "right_anti":
        return f2.join(f1.select(*keys), keys, "left_anti")
    return f1.join(f2, keys, mode)


def sort_dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """SUM FIELDS=NONE: the first row of each key."""
    by = W.Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(by)).where("rn_ = 1").drop("rn_")


def overlaps(ranges: DataFrame, fields: DataFrame) -> DataFrame:
    """Byte ranges (record, lo, hi) with the fields (record, start, end) that they touch.

    The equi-key record comes first, so only one layout's fields meet one record's ranges.
    """
    return ranges.join(fields, "record").where((F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")))


def composed(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Composition of byte maps: outer takes (record, out, src, len) from a record that inner builds (record, out, src, len).

    Returns record, out, src, len from the inner record's source to the outer record.
    """
    o = outer.select("record", F.col("out").alias("o_out"), F.col("src").alias("o_src"), F.col("len").alias("o_len"))
    i = inner.select("record", F.col("out").alias("i_out"), F.col("src").alias("i_src"), F.col("len").alias("i_len"))
    lo = F.greatest("o_src", "i_out")
    hi = F.least(F.col("o_src") + F.col("o_len"), F.col("i_out") + F.col("i_len"))
    met = o.join(i, "record").where(lo < hi)
    return met.select("record", (F.col("o_out") + lo - F.col("o_src")).alias("out"), (F.col("i_src") + lo - F.col("i_out")).alias("src"), (hi - lo).alias("len"))


def unique_matches(names: DataFrame, templates: DataFrame) -> DataFrame:
    """Templates (template, with ``*`` for any run) with the one name that each matches; ambiguous ones are left out.

    A template without star is its own key. Otherwise the longer of its literal beginning and
    end is an equi-key, met by the beginnings or ends of a name that have a length which occurs;
    without either, its first literal between stars, met by the names' stretches of such a
    length. The pattern itself is only tried on names that hold this literal. Stars alone match
    every name, so one only if there is no other.
    """
    head, tail = F.substring_index("template", "*", 1), F.substring_index("template", "*", -1)
    middle = F.regexp_extract("template", r"^\*+([^*]+)\*", 1)
    kind = F.when(~F.contains("template", F.lit("*")), "whole").when((head == "") & (tail == "") & (middle == ""), "any").when((head == "") & (tail == ""), "middle").when(F.length(tail) > F.length(head), "end").otherwise("begin")
    # settled, so that Spark knows which side is small: it takes the names for no more than their file and would send out all their pieces
    t = settled(templates.withColumn("kind_", kind).withColumn("key_", F.when(F.col("kind_") == "middle", middle).when(F.col("kind_") == "end", tail).otherwise(head)))
    lengths: dict[str, list[int]] = {"begin": [], "middle": [], "end": []}
    for r in t.where(F.col("kind_").isin(*lengths)).select("kind_", F.length("key_").alias("length")).distinct().collect():
        lengths[r["kind_"]].append(r["length"])
    long = F.length("name")

    def pieces(kind: str) -> Column:
        fitting = F.filter(F.lit(lengths[kind]).cast("array<int>"), lambda k: k <= long)
        if kind == "begin":
            found = F.transform(fitting, lambda k: F.substr("name", F.lit(1), k))
        elif kind == "end":
            found = F.transform(fitting, lambda k: F.substr("name", long - k + 1, k))
        else:
            found = F.array_distinct(F.flatten(F.transform(fitting, lambda k: F.transform(F.sequence(F.lit(1), long - k + 1), lambda at: F.substr("name", at, k)))))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind_"), x.alias("key_")))

    whole = F.array(F.struct(F.lit("whole").alias("kind_"), F.col("name").alias("key_")))
    keys = F.concat(whole, *(pieces(k) for k in lengths if lengths[k]))
    # numbers stand for names while matches are counted: they are added up in place, names would have to be sorted
    names = settled(names.where("name is not null").select("name", F.monotonically_increasing_id().alias("id_")))
    n = names.select("id_", "name", F.explode(keys).alias("k_")).select("id_", "name", "k_.kind_", "k_.key_")
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("template", r"([.\\+?(){}\[\]^$|])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    met = n.join(t, ["kind_", "key_"]).where(F.regexp_like("name", pattern))
    counted = met.groupBy("template").agg(F.count("*").alias("n_"), F.min("id_").alias("id_"))
    lone = names.agg(F.count("*").alias("n_"), F.first("name").alias("name")).where("n_ = 1").select("name")
    stars = t.where("kind_ = 'any'").select("template").distinct().crossJoin(lone)
    return counted.where("n_ = 1").join(names, "id_").select("template", "name").unionByName(stars)


def paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Positional pairing of two ordered lists (``pos`` in both), only where both have the same length."""
    size = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    same = size(left, "nl_").join(size(right, "nr_"), keys).where("nl_ = nr_").select(*keys)
    return left.join(right, [*keys, "pos"]).join(same, keys, "left_semi")


def merged(target: DataFrame, source: DataFrame, keys: list[str], values: list[str], insert: bool = False) -> DataFrame:
    """MERGE: matched rows take the source's values; with ``insert``, unmatched source rows are added."""
    s = source.select(*keys, *[F.col(v).alias(f"s_{v}") for v in values], F.lit(True).alias("s_"))
    out = target.join(s, keys, "full" if insert else "left")
    return out.select(*[F.when(F.col("s_"), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an idempotent upsert of appended rows."""
    return sort_dedupe(df, keys, [c.desc() for c in order])
