"""Accumulation in an order that the rows carry: merged entities, and sources and logic of a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import settled


def merged_nodes(mentions: DataFrame) -> DataFrame:
    """One row for each id of mentions (id, ord, language, path, columns, attributes): the first of each, by ord, wins.

    Columns are united and sorted. Attributes are merged key by key; null values, and null columns, win nowhere. Equal
    ``ord`` goes by the smaller value. Every step aggregates small rows (id and one value) before the shuffle, so an id
    of very many mentions costs one row a task; only its own result stands in one row. Other columns are ignored.
    """
    m = mentions.select("id", "ord", "language", "path", "columns", "attributes")
    m = settled(m)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("v"))))["v"].alias(c)
    told = m.groupBy("id").agg(first("language"), first("path"))
    columns = m.select("id", F.explode("columns").alias("c")).where("c is not null").distinct().groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("columns"))
    each = m.select("id", "ord", F.explode("attributes").alias("k", "v")).where("v is not null")
    each = each.groupBy("id", "k").agg(F.min(F.struct("ord", "v"))["v"].alias("v"))
    attributes = each.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    out = told.join(columns.withColumnRenamed("id", "c_id"), F.col("id").eqNullSafe(F.col("c_id")), "left").join(attributes.withColumnRenamed("id", "a_id"), F.col("id").eqNullSafe(F.col("a_id")), "left")
    none = F.create_map().cast(m.schema["attributes"].dataType)
    return out.select("id", "language", "path", F.coalesce("columns", F.array().cast(m.schema["columns"].dataType)).alias("columns"), F.coalesce("attributes", none).alias("attributes"))


def accumulated(facts: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """keys, sources, logic: a target's distinct sources, and its distinct logic joined by ``; ``, both in the order they first came.

    facts: keys, the order column, source, logic; equal order goes by the text. Nulls are left out, and a target
    with nothing else has no sources and an empty logic. Distinct values are found before a target's list is made.
    """
    def ordered(c: str, name: str) -> DataFrame:
        firsts = facts.groupBy(*keys, c).agg(F.min(order).alias("at_"))
        listed = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at_", F.col(c).alias("x")))))
        return firsts.groupBy(*keys).agg(F.transform(listed, lambda s: s["x"]).alias(name))

    right = ordered("logic", "logic_").select(*[F.col(k).alias(f"{k}_r") for k in keys], "logic_")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys]
    return ordered("source", "sources").join(right, same).select(*keys, "sources", F.array_join("logic_", "; ").alias("logic"))
