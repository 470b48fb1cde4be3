"""Graph operators over an edge table ``source_id, target_id, edge_type`` (further columns pass through)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import settled

RELATIONS = ("READS_FROM", "WRITES_TO", "EXECUTES", "TRANSFORMS_TO")
#: Bounds of a neighbourhood's depth, and of a variable's resolution.
DEPTHS = (1, 8)
RESOLVE_DEPTH = 12


def edge_id(source: Column, kind: Column, target: Column, program: Column, transformation: Column) -> Column:
    """First 16 hex digits of the SHA-1 over the parts joined by ``|``; a missing part counts as ``None``."""
    parts = [F.coalesce(p.cast("string"), F.lit("None")) for p in (source, kind, target, program, transformation)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def node_kind(node: Column) -> Column:
    return F.substring_index(node, ":", 1)


def owner(column_id: Column) -> Column:
    """The entity of ``entity|column``: everything before the last bar."""
    return F.regexp_extract(column_id, r"^(.*)\|[^|]*$", 1)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id"))).distinct()


def distances(edges: DataFrame, start: DataFrame, depth: int, directed: str = "both") -> DataFrame:
    """``id, dist`` of all nodes within ``depth`` steps of the nodes in ``start`` (column id).

    Breadth-first: each step joins only the last frontier and leaves out what was reached, so
    a node is expanded once; the frontier is written each step, and the search ends when it is empty.
    """
    if depth > 1:  # read by every step
        edges = settled(edges.select("source_id", "target_id"))
    down = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to"))
    up = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("to"))
    steps = {"down": down, "up": up, "both": down.union(up)}[directed]
    # written, as a frontier of unknown size would have all steps moved to it
    frontier = settled(start.select("id").distinct().withColumn("dist", F.lit(0).cast("long")))
    reached = frontier
    for k in range(1, depth + 1):
        new = frontier.select("id").join(steps, "id").select(F.col("to").alias("id")).distinct()
        frontier = settled(new.join(reached.select("id"), "id", "left_anti").withColumn("dist", F.lit(k).cast("long")))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def shortest_path_edges(edges: DataFrame, start: DataFrame, targets: DataFrame, depth: int = RESOLVE_DEPTH) -> DataFrame:
    """The edges of all shortest paths from the nodes in ``start`` to each node in ``targets`` (column id), with ``dist``, the steps from the start to an edge's end.

    Distances first; an edge that leads one step further out is a predecessor edge. The walk back from the targets
    joins only the last frontier with these, a step nearer to the start each round.
    """
    near = settled(distances(edges, start, depth, "down"))
    out = near.select(F.col("id").alias("source_id"), F.col("dist").alias("before"))
    end = near.select(F.col("id").alias("target_id"), "dist")
    steps = settled(edges.join(out, "source_id").join(end, "target_id").where("dist = before + 1").select(*edges.columns, "dist"))
    frontier = settled(targets.select(F.col("id").alias("target_id")).distinct().join(end, "target_id").where("dist > 0").select("target_id"))
    found = steps.limit(0)
    while not frontier.isEmpty():
        back = settled(steps.join(frontier, "target_id", "left_semi").select(*steps.columns))
        found = found.unionByName(back)
        # a node's distance is the same on every path, so a later round can meet one again: it is walked once
        frontier = settled(back.where("dist > 1").select(F.col("source_id").alias("target_id")).distinct().join(found.select("target_id").distinct(), "target_id", "left_anti"))
    return found.distinct()


def neighbourhood(edges: DataFrame, node: str, depth: int = 3) -> DataFrame:
    """Edges on a path of at most ``depth`` edges from a node: those with an end at most ``depth - 1`` away."""
    depth = min(max(depth, DEPTHS[0]), DEPTHS[1])
    start = edges.sparkSession.createDataFrame([(node,)], "id string")
    # written once: each step reads them, and meets a small frontier without moving them
    relations = settled(edges.where(F.col("edge_type").isin(*RELATIONS)))
    near = settled(distances(relations, start, depth - 1).select("id"))
    ends = [relations.join(near.withColumnRenamed("id", c), c, "left_semi").select(*edges.columns) for c in ("source_id", "target_id")]
    return ends[0].union(ends[1]).distinct()


def neighbourhood_columns(edges: DataFrame, column_edges: DataFrame, node: str, depth: int = 3) -> DataFrame:
    """Column edges whose owners both lie in the neighbourhood of a node."""
    ids = settled(nodes_of(neighbourhood(edges, node, depth)))
    own = column_edges.withColumns({"so_": owner(F.col("source_id")), "to_": owner(F.col("target_id"))})
    return own.join(ids.withColumnRenamed("id", "so_"), "so_", "left_semi").join(ids.withColumnRenamed("id", "to_"), "to_", "left_semi").drop("so_", "to_")


def data_flow_counts(edges: DataFrame) -> DataFrame:
    """For each entity read, the number of (process, target) pairs its data flows to through a process that writes.

    A process with r reads and w writes has r * w flows less those to itself; they are counted
    from the two lists' sizes, never listed.
    """
    reads = edges.where("edge_type = 'READS_FROM'").select(F.col("source_id").alias("entity"), F.col("target_id").alias("process")).distinct()
    writes = edges.where("edge_type = 'WRITES_TO'").select(F.col("source_id").alias("process"), F.col("target_id").alias("entity")).distinct()
    per_process = writes.groupBy("process").agg(F.count("*").alias("w"))
    own = writes.withColumn("self", F.lit(1).cast("long"))
    flows = reads.join(per_process, "process").join(own, ["process", "entity"], "left")
    return flows.groupBy(F.col("entity").alias("source_id")).agg(F.sum(F.col("w") - F.coalesce("self", F.lit(0))).cast("long").alias("n_flows")).where("n_flows > 0")


def handoff_counts(edges: DataFrame) -> DataFrame:
    """For each entity, the number of pairs of a writer and another reader: counted from sizes, as above."""
    reads = edges.where("edge_type = 'READS_FROM'").select(F.col("source_id").alias("entity"), F.col("target_id").alias("process")).distinct()
    writes = edges.where("edge_type = 'WRITES_TO'").select(F.col("source_id").alias("process"), F.col("target_id").alias("entity")).distinct()
    marks = reads.withColumn("r", F.lit(1)).withColumn("w", F.lit(0)).unionByName(writes.withColumn("r", F.lit(0)).withColumn("w", F.lit(1)))
    each = marks.groupBy("entity", "process").agg(F.max("r").alias("r"), F.max("w").alias("w"))
    out = each.groupBy("entity").agg((F.sum("r") * F.sum("w") - F.sum(F.col("r") * F.col("w"))).cast("long").alias("n_handoffs"))
    return out.where("n_handoffs > 0")


def missing_reads(edges: DataFrame, column_edges: DataFrame) -> DataFrame:
    """READS_FROM edges that column edges imply (an owner feeds a program) and the entity edges lack."""
    implied = column_edges.select(owner(F.col("source_id")).alias("source_id"), owner(F.col("target_id")).alias("target_id")).where("target_id like 'PROGRAM:%'").distinct()
    return implied.join(edges.where("edge_type = 'READS_FROM'"), ["source_id", "target_id"], "left_anti").withColumn("edge_type", F.lit("READS_FROM"))


def terminals(steps: DataFrame, depth: int = RESOLVE_DEPTH) -> DataFrame:
    """Resolve variables to terminals: ``target, terminal, dist`` over ``steps`` (target, source).

    A terminal is a source that nothing transforms. Distances are shortest; what lies deeper
    than ``depth`` is left out, and so are cycles, as a pair is kept once.
    """
    heads = steps.select(F.col("target").alias("source")).distinct()
    frontier = steps.select("target", "source").distinct().withColumn("dist", F.lit(1).cast("long"))
    reached = frontier
    for k in range(2, depth + 1):
        new = frontier.select("target", F.col("source").alias("mid")).join(steps.select(F.col("target").alias("mid"), "source"), "mid").select("target", "source").distinct()
        frontier = settled(new.join(reached.select("target", "source"), ["target", "source"], "left_anti").withColumn("dist", F.lit(k).cast("long")))
        reached = reached.union(frontier)
        if frontier.isEmpty():
            break
    return reached.join(heads, "source", "left_anti").select("target", F.col("source").alias("terminal"), "dist")


def dedupe_nodes(mentions: DataFrame) -> DataFrame:
    """One row for each id: sorted union of its columns, first non-null path by ``seq``. mentions: id, path, columns, seq."""
    firsts = mentions.groupBy("id").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("seq"))).alias("path"))
    columns = mentions.select("id", F.explode_outer("columns").alias("c")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("columns"))
    return firsts.join(columns, "id")


def absorb(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rewrite ids by a mapping ``old, new`` at both ends (template nodes to concrete ones); equal edges fall together."""
    m = aliases.select("old", "new")
    out = edges.join(m.withColumnsRenamed({"old": "source_id", "new": "s_"}), "source_id", "left").join(m.withColumnsRenamed({"old": "target_id", "new": "t_"}), "target_id", "left")
    return out.select(F.coalesce("s_", "source_id").alias("source_id"), F.coalesce("t_", "target_id").alias("target_id"), "edge_type").distinct()


def column_counts(nodes: DataFrame, columns: DataFrame) -> DataFrame:
    """Every node with its kind and number of columns, none counting 0. nodes: id; columns: owner_id, name."""
    n = columns.groupBy("owner_id").agg(F.count("name").alias("n"))
    return nodes.join(n, nodes["id"] == n["owner_id"], "left").select("id", node_kind(F.col("id")).alias("kind"), F.coalesce("n", F.lit(0)).alias("n_columns"))
