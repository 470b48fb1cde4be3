"""The lineage graph as stored tables: idempotent upserts, wipe, and export as one JSON document.

A stored table is Parquet in folders by bucket, a hash of its key. An upsert reads and rewrites only the
buckets that its rows fall in: old rows of these buckets less those of the new keys, and the new rows, are
written aside first and then moved in place bucket by bucket, so a run that is repeated gives the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.operators.graph import owner
from weftline.session import settled, shared_dir

#: Tables of a stored graph, and the columns that tell their rows apart.
KEYS = {"nodes": ["id"], "columns": ["id"], "edges": ["edge_id"], "column_edges": ["source_id", "target_id", "program"]}
BUCKETS = 64


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, fs = _path(spark, path)
    return fs.exists(found)


def upsert(rows: DataFrame, path: str, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Put rows into a stored table, in the place of rows of the same keys; returns the whole table.

    Of several rows of one key the last by ``order`` stays, and without an order the greatest by all columns. Null
    keys count as one key. ``buckets`` is fixed by a table's first upsert. The rows' keys are read once more than the
rows, to know the buckets.
    """
    spark = rows.sparkSession
    in_place = exists(spark, path)
    both = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("new_", F.lit(1))
    columns = [*rows.columns]
    if in_place:
        touched = [r["bucket"] for r in both.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).withColumn("new_", F.lit(0))
        both = old.unionByName(both, allowMissingColumns=True)
        columns = [c for c in both.columns if c not in ("bucket", "new_")]
    # old and new rows meet in one shuffle by bucket, behind which a key's rows are told apart
    last = [F.col("new_").desc(), *[F.col(c).desc_nulls_last() for c in (order or [])], F.to_json(F.struct(*rows.columns)).desc()]
    ranked = both.repartition("bucket").withColumn("rank_", F.row_number().over(W.Window.partitionBy("bucket", *keys).orderBy(*last)))
    merged = ranked.where("rank_ = 1").select(*columns, "bucket")
    if not in_place:
        merged.write.partitionBy("bucket").parquet(path)
    else:
        aside = f"{shared_dir(spark)}/weftline-aside-{uuid.uuid4().hex}"
        merged.write.partitionBy("bucket").parquet(aside)
        _put_in_place(spark, aside, path)
    return spark.read.schema(merged.schema).parquet(path).drop("bucket")


def _put_in_place(spark: SparkSession, aside: str, path: str) -> None:
    """Move the bucket folders of a table written aside to their places in the stored table; the files themselves are not read or copied."""
    new, fs = _path(spark, aside)
    for status in fs.listStatus(new):
        if status.isDirectory():
            target, _ = _path(spark, f"{path}/{status.getPath().getName()}")
            fs.delete(target, True)
            if not fs.rename(status.getPath(), target):
                raise OSError(f"{status.getPath()} could not be moved to {target}")
    fs.delete(new, True)


def columns_of(nodes: DataFrame, column_edges: DataFrame) -> DataFrame:
    """id, name, owner_id of every column that a node states or a column edge touches."""
    stated = nodes.select(F.col("id").alias("owner_id"), F.explode(F.transform("columns", F.upper)).alias("name"))
    ends = column_edges.select(F.explode(F.array("source_id", "target_id")).alias("c")).select(owner(F.col("c")).alias("owner_id"), F.upper(F.regexp_extract("c", r"\|([^|]*)$", 1)).alias("name"))
    both = stated.unionByName(ends).where("name <> ''").distinct()
    return both.select(F.concat_ws("|", "owner_id", "name").alias("id"), "name", "owner_id")


def write_graph(folder: str, nodes: DataFrame, edges: DataFrame, column_edges: DataFrame) -> dict[str, DataFrame]:
    """Upsert a graph's four tables; returns them as stored. Edges whose ends are no nodes, stored or new, are left out, as there is nothing to tie them to."""
    stored = {"nodes": upsert(nodes, f"{folder}/nodes", KEYS["nodes"])}
    ids = stored["nodes"].select("id")
    tied = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    stored["edges"] = upsert(tied.select(*edges.columns), f"{folder}/edges", KEYS["edges"])
    stored["columns"] = upsert(columns_of(nodes, column_edges), f"{folder}/columns", KEYS["columns"])
    stored["column_edges"] = upsert(column_edges, f"{folder}/column_edges", KEYS["column_edges"])
    return stored


def read_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}").drop("bucket") for name in KEYS}


def wipe(spark: SparkSession, folder: str) -> None:
    """Delete the four tables; a folder without any is left as it is."""
    for name in KEYS:
        found, fs = _path(spark, f"{folder}/{name}")
        fs.delete(found, True)


def export_json(folder: str, codec: str = "none", **arrays: DataFrame) -> None:
    """Write one JSON document with an array for each table, as text files whose concatenation by name is the document.

    With ``codec`` gzip the files are packed, and their concatenation is the packed document.

    Rows stand in the order of their JSON, equal rows once. They are ranged over the files by (array, row), so no task
    or driver holds a whole array; a row begins with the comma before it, unless it is its array's first.
    """
    lines, last = None, len(arrays) - 1
    for k, (name, rows) in enumerate(arrays.items()):
        each = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))
        body = each.select(F.lit(1).alias("at"), "json", F.lit("").alias("value"))
        frame = rows.sparkSession.createDataFrame([(0, "", ("{" if k == 0 else "") + f'"{name}": ['), (2, "", "]" + ("}" if k == last else ","))], "at int, json string, value string")
        part = body.unionByName(frame).withColumn("array", F.lit(k))
        lines = part if lines is None else lines.unionByName(part)
    firsts = settled(lines.where("at = 1").groupBy("array").agg(F.min("json").alias("first")))
    order = ["array", "at", "json"]
    # equal rows fall in one range, so they are told apart behind the one shuffle
    ranged = lines.repartitionByRange(*order).dropDuplicates(order).join(F.broadcast(firsts), "array", "left")
    own = F.concat(F.when(F.col("json") == F.col("first"), "").otherwise(","), "json")
    ranged.sortWithinPartitions(*order).select(F.when(F.col("at") == 1, own).otherwise(F.col("value")).alias("value")).write.mode("overwrite").option("compression", codec).text(folder)
