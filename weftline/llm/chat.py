"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every speaker of a conversation the whole dialogue is rendered with that speaker as the
assistant and the others as named users; ``system`` turns stay system turns and are nobody's
perspective. The rendering comes turn by turn, with the offsets of each piece in the whole text,
so a dialogue of any length is never gathered into one row: the pieces of a perspective, laid
side by side in order of ``pos``, are its text, and ``mask_start`` and ``mask_end`` (code points,
end exclusive) cut the speaker's own turns with their end marks out of it. ``whole_dialogues``
puts them together where dialogues are known to be short.

A conversation's offsets are running sums over stretches of ``STRETCH`` turn numbers, to which
the sums of the stretches before are added, so a long conversation spreads over tasks; the
length of a stretch does not change the result.

Defined cases: turns are ordered by number (null first), role and text, repeated rows stay;
a null role speaks as ``unknown``, a null text is empty; a row without conversation id is a
conversation of its own; a conversation of system turns only gives no rows; marks inside a
text or role are broken by a space and line ends in a role become spaces, so neither can open or
end a turn, and roles equal after that are one speaker; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Turn numbers of one stretch.
STRETCH = 4096


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """One row for each conversation, speaker and turn: conv_id, speaker, pos, own, text, start, mask_start, mask_end."""
    unbroken = lambda c: F.replace(c, F.lit("<|im_"), F.lit("< |im_"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn_col) / stretch), F.lit(None)).cast("long").alias("part"),
        F.col(turn_col).alias("turn"),
        unbroken(F.translate(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")), "\n\r", "  ")).alias("role"),
        F.concat(unbroken(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit("<|im_end|>")).alias("body"),
    )
    known, alone = rows.where("conv_id is not null"), rows.where("conv_id is null and role <> 'system'")
    speakers = known.where("role <> 'system'").select("conv_id", F.col("role").alias("speaker")).distinct()
    own = F.col("role") == F.col("speaker")
    named = F.concat(F.lit("<|im_start|>user name="), F.col("role"))
    head = F.concat(F.when(own, "<|im_start|>assistant").when(F.col("role") == "system", "<|im_start|>system").otherwise(named), F.lit("\n"))

    # within a stretch: rows of a conversation's stretch lie in one partition for all its speakers
    each = known.repartition("conv_id", "part").join(speakers, "conv_id").select("*", own.alias("own"), head.alias("head"))
    each = each.withColumn("size", (F.length("head") + F.length("body") + 1).cast("long"))
    before = W.Window.partitionBy("conv_id", "part", "speaker").orderBy(F.asc_nulls_first("turn"), "role", "body").rowsBetween(W.Window.unboundedPreceding, 0)
    inside = each.withColumns({"k": F.row_number().over(before), "at": F.sum("size").over(before) - F.col("size")})

    # over stretches: sums of the stretches before, for conversations that have several
    stretches = known.groupBy("conv_id", "part", "role").agg(F.count("*").alias("n"), F.sum(F.length("body") + 1).alias("body"))
    several = stretches.groupBy("conv_id").agg(F.count_distinct(F.coalesce("part", F.lit(-(1 << 62)))).alias("parts")).where("parts > 1").select("conv_id")
    sums = stretches.join(several, "conv_id", "left_semi").join(speakers, "conv_id").select("*", own.alias("own"), head.alias("head"))
    sums = sums.groupBy("conv_id", "speaker", "part").agg(F.sum("n").alias("n"), F.sum(F.col("body") + F.col("n") * F.length("head")).alias("size"))
    past = W.Window.partitionBy("conv_id", "speaker").orderBy(F.asc_nulls_first("part")).rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c_"), F.col("speaker").alias("s_"), F.col("part").alias("p_"), F.sum("n").over(past).alias("n_"), F.sum("size").over(past).alias("at_"))
    out = inside.join(sums, (F.col("conv_id") == F.col("c_")) & (F.col("speaker") == F.col("s_")) & F.col("part").eqNullSafe(F.col("p_")), "left")
    out = out.select("conv_id", "speaker", (F.col("k") + F.coalesce("n_", F.lit(0))).alias("pos"), "own", "head", "body", (F.col("at") + F.coalesce("at_", F.lit(0))).alias("start"))

    single = alone.withColumn("speaker", F.col("role")).select("conv_id", "speaker", F.lit(1).cast("long").alias("pos"), own.alias("own"), head.alias("head"), "body", F.lit(0).cast("long").alias("start"))
    begin = F.col("start") + F.length("head")
    return out.unionByName(single).select(
        "conv_id",
        "speaker",
        "pos",
        "own",
        F.concat("head", "body", F.lit("\n")).alias("text"),
        "start",
        F.when(F.col("own"), begin).alias("mask_start"),
        F.when(F.col("own"), begin + F.length("body")).alias("mask_end"),
    )


def whole_dialogues(pieces: DataFrame) -> DataFrame:
    """The pieces of each perspective as one row: conv_id, speaker, n_turns, text, mask (``start:end`` spans). Gathers a dialogue in a row."""
    pieces = pieces.where("conv_id is not null")
    span = F.when(F.col("own"), F.concat_ws(":", F.col("mask_start"), F.col("mask_end")))
    rows = F.array_sort(F.collect_list(F.struct("pos", "text", span.alias("span"))))
    grouped = pieces.groupBy("conv_id", "speaker").agg(rows.alias("rows"))
    return grouped.select("conv_id", "speaker", F.size("rows").cast("long").alias("n_turns"), F.array_join("rows.text", "").alias("text"), F.array_join("rows.span", ",").alias("mask"))


#: The same rows in DuckDB.
ROTATE_SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(translate(coalesce(role, 'unknown'), chr(10) || chr(13), '  '), '<|im_', '< |im_') AS role,
         replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' AS body,
         CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone
  FROM conversations),
s AS (SELECT DISTINCT conv_id, alone, role AS speaker FROM t WHERE role <> 'system'),
g AS (
  SELECT t.conv_id, t.alone, s.speaker, turn, role, body, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|im_start|>assistant' WHEN role = 'system' THEN '<|im_start|>system'
              ELSE '<|im_start|>user name=' || role END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.alone IS NOT DISTINCT FROM s.alone),
p AS (
  SELECT *, row_number() OVER w AS pos,
         (sum(length(head) + length(body) + 1) OVER w - length(head) - length(body) - 1)::BIGINT AS start
  FROM g WINDOW w AS (PARTITION BY conv_id, alone, speaker ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, pos, own, head || body || chr(10) AS text, start,
       CASE WHEN own THEN start + length(head) END AS mask_start, CASE WHEN own THEN start + length(head) + length(body) END AS mask_end
FROM p
"""
