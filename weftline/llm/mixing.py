"""Mixing sources to target weights by Pareto order sampling.

Within a source a document's expected copies are in proportion to a weight that falls with its
length (``words ** -TEMPER``), at most ``most``, and scaled so that the expected words meet the
source's target; what is beyond ``most`` is spread over the others. Whole copies are certain; the
fraction is the document's inclusion probability ``p``. Documents of one source and about one
length are a stratum, from which a sample of fixed size is taken by Pareto order sampling: ranked
by the random odds ``u / (1-u)`` over the inclusion odds ``p / (1-p)``, those with the least
ranks are in. The size is the sum of ``p``, rounded; the words that rounding adds or leaves out
are made up by the stratum of the next shorter documents.

A sample's last rank is found by counting: ranks are cut into 1,024 ranges, the range of the last
rank into 1,024 again, until it holds few documents, and only those are sorted.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
equal rows (id, source and text) are one unit and share a decision; documents without words
are sampled like the others and add nothing; those of a source without any words are left out;
an empty table gives no rows; other columns are ignored, whatever their names. ``u`` comes from a
hash of id and text, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from weftline.llm.common import materialise

#: Expected copies fall with this power of the length.
TEMPER = 0.25
#: Length classes of a doubling, and classes of a stratum.
STEPS, STRATUM = 16, 4
#: Ranges of one count, as a power of two, and how many counts at most; up to so many documents are sorted.
RANGE_BITS, COUNTS, SORTED = 10, 5, 1000
#: Weights are stated by source, so the sources come to the driver; more of them are an error.
MOST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text_col: str = "text"):
    """Number of words, as a column."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weights(sources: list[str | None]) -> list[float]:
    """1, 2, 3, repeating, over the sources in code point order, null last."""
    return [float(k % 3 + 1) for k in range(len(sources))]


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = 3.0) -> list[float]:
    """Words of each source: ``share`` of all words by weight, at most ``most`` times its own; the excess is reshared."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    live = [k for k in range(len(sizes)) if weights[k] > 0]
    while live:
        total = sum(weights[k] for k in live)
        over = [k for k in live if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in live:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in over)
        live = [k for k in live if k not in set(over)]
    return out


def expected_copies(classes: list[tuple[float, int]], target: float, most: float) -> list[float]:
    """Copies of each class (weight, words): in proportion to the weight, at most ``most``, so that the words meet the target."""
    out, left, rest = [0.0] * len(classes), target, sum(w * n for w, n in classes)
    if target >= most * sum(n for _, n in classes) * (1 - 1e-12):
        return [most if target > 0 else 0.0] * len(classes)
    for k in sorted(range(len(classes)), key=lambda k: -classes[k][0]):
        w, n = classes[k]
        copies = left * w / rest if rest > 0 else 0.0
        out[k] = min(most, copies)
        if copies >= most:
            left, rest = left - most * n, rest - w * n
    return out


def sample_sizes(strata: list[tuple[float, float, int, int]]) -> list[int]:
    """Sizes of the samples of strata (sum of p, expected words, units with p > 0, their words), longest texts first.

    The sum of p is rounded up or down: to the nearer, unless the strata after it can't make up
    for the words that this adds or leaves out, as far as they have units to take or leave.
    """
    out, carry = [], 0.0
    room = sum(total - expected for _, expected, _, total in strata)
    held = sum(expected for _, expected, _, _ in strata)
    for p, expected, units, total in strata:
        room, held = room - (total - expected), held - expected
        mean = expected / p if p else 0.0
        n = round(p)
        if mean:
            whole = math.floor((expected + carry) / mean)
            beyond = lambda n: (max(0.0, carry + expected - n * mean - room) + max(0.0, n * mean - carry - expected - held), abs(carry + expected - n * mean))  # noqa: E731, B023
            n = min((min(units, max(0, m)) for m in (whole, whole + 1)), key=beyond)
        carry += expected - n * mean
        out.append(min(units, n))
    return out


def length_class(words):
    """Class of a unit by its words: STEPS to a doubling."""
    return F.floor(F.log2(words + 1) * STEPS).cast("int")


def _plan(found: list, weights, share: float, most: float) -> tuple[list[tuple], list[tuple]]:
    """Rows for each class and for each stratum, from (source, class, words, units) rows."""
    size: dict = {}
    for r in found:
        size[r["source"]] = size.get(r["source"], 0) + r["words"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    classes, strata = [], []
    for name, target in zip(names, targets([size[s] for s in names], weights(names), share, most), strict=True):
        own = sorted((r for r in found if r["source"] == name), key=lambda r: -r["class"])
        copies = expected_copies([(2.0 ** (-TEMPER * r["class"] / STEPS), r["words"]) for r in own], target, most)
        held: dict[int, list[float]] = {}
        for r, e in zip(own, copies, strict=True):
            whole = int(e + 1e-9)
            p = e - whole if e - whole > 1e-9 else 0.0
            classes.append((name, r["class"], size[name], target, whole, p))
            sums = held.setdefault(r["class"] // STRATUM, [0.0, 0.0, 0, 0])
            if p:
                sums[0] += p * r["units"]
                sums[1] += p * r["words"]
                sums[2] += r["units"]
                sums[3] += r["words"]
        sizes = sample_sizes([tuple(v) for v in held.values()])
        strata += [(name, s, n, v[2]) for (s, v), n in zip(held.items(), sizes, strict=True)]
    return classes, strata


def mix_plan(docs: DataFrame, weights: Callable[[list[str | None]], list[float]] = cycling_weights, share: float = 1.0, most: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies that the mix takes of each unit of equal rows.

    Returns doc_id, source, h (hash of the text), size, rows, source_size, target, whole, p, u,
    stratum, copies. Classes and strata are at most some hundreds a source.
    """
    spark = docs.sparkSession
    units = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    units = materialise(units.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("rows")), "units")
    if units.select("source").distinct().limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    units = units.withColumn("words", F.col("size") * F.col("rows")).withColumn("class", length_class(F.col("words"))).withColumn("stratum", F.floor(F.col("class") / STRATUM).cast("int"))
    found = units.groupBy("source", "class").agg(F.sum("words").alias("words"), F.count("*").alias("units")).collect()
    classes, strata = _plan(found, weights, share, most)
    classes = spark.createDataFrame(classes, "source string, class int, source_size long, target double, whole int, p double")
    strata = spark.createDataFrame(strata, "source string, stratum int, n long, units long")

    def with_table(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        """A join on keys that may be null; Spark broadcasts the table if it is small."""
        on = [df[k].eqNullSafe(table[k]) for k in keys]
        return df.join(table, on, how).select(df["*"], *[table[c] for c in table.columns if c not in keys])

    units = with_table(units, classes, ["source", "class"])
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "h"), 11) + 0.5) / float(1 << 53)
    units = units.withColumn("u", u).withColumn("rank", F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")))
    # ranks as whole numbers in the same order, so that ranges are cut exactly
    bits = RANGE_BITS * COUNTS
    place = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    units = units.withColumn("place", place).drop("class", "words")
    ranked = units.where("p > 0").select("source", "stratum", "place")

    # the range [low, low + 2 ** left) of each stratum's last rank, and how many of it are in
    ends = strata.where("n > 0 and n < units").select("source", "stratum", F.lit(0).cast("long").alias("low"), F.col("n").alias("need"))
    left = bits
    while left:
        left -= RANGE_BITS
        inside = with_table(ranked, ends, ["source", "stratum"]).where((F.col("place") >= F.col("low")) & (F.shiftright(F.col("place") - F.col("low"), left + RANGE_BITS) == 0))
        counted = inside.groupBy("source", "stratum", "need", (F.shiftright("place", left) * F.lit(1 << left)).alias("low")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.Window.partitionBy("source", "stratum").orderBy("low").rowsBetween(W.Window.unboundedPreceding, 0))
        counted = counted.withColumn("before", upto - F.col("n")).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
        ends = materialise(counted.select("source", "stratum", "low", (F.col("need") - F.col("before")).alias("need"), "n"), "ends")
        if (ends.agg(F.max("n")).first()[0] or 0) <= SORTED:
            break
        ends = ends.drop("n")

    cut = strata.join(ends.withColumnsRenamed({"source": "s_", "stratum": "t_"}).drop("n"), [strata["source"].eqNullSafe(F.col("s_")), strata["stratum"] == F.col("t_")], "left").drop("s_", "t_")
    placed = with_table(units, cut, ["source", "stratum"])
    at_end = F.coalesce((F.col("place") >= F.col("low")) & (F.shiftright(F.col("place") - F.col("low"), left) == 0), F.lit(False))
    keep = ["doc_id", "source", "h", "size", "rows", "source_size", "target", "whole", "p", "u", "stratum"]
    more = F.coalesce(F.when(F.col("p") == 0, 0).when(F.col("low").isNull(), (F.col("n") > 0).cast("int")).otherwise((F.col("place") < F.col("low")).cast("int")), F.lit(0))
    clear = placed.where(~at_end).select(*keep, more.alias("more"))
    order = W.Window.partitionBy("source", "stratum").orderBy("rank", "doc_id", "h", "size")
    edge = placed.where(at_end).withColumn("k", F.row_number().over(order)).select(*keep, (F.col("k") <= F.col("need")).cast("int").alias("more"))
    return clear.unionByName(edge).withColumn("copies", (F.col("whole") + F.col("more")).cast("long")).drop("more")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken (size times copies), copies."""
    plan = mix_plan(docs, **options)
    each = plan.withColumn("row_", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, with its own columns."""
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    plan = plan.where("copies > 0").select("doc_id", "source", "h", "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"), F.col(source_col).cast("string").alias("own_source"), F.xxhash64(F.col(text_col).cast("string")).alias("own_h"))
    each = rows.join(plan, F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_h") == F.col("h")))
    return each.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast(T.IntegerType())))).select("row.*")
