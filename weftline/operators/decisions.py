"""Conditional and lookup operators: decision tables, reference lookups, control rules, quality splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reference tables of the described programs, in basis points.
CCF_BPS = {"CARD": 5000, "LOAN": 10000, "MORT": 7500, "OVDR": 7500}
CCF_DEFAULT = 10000
LGD_BPS = {"CA": 150, "GU": 250, "RE": 100, "SE": 350}
LGD_DEFAULT = 4500
RISK_WEIGHT = {"CASH": "1.50", "GAMB": "2.00", "RETL": "1.00"}
RISK_WEIGHT_DEFAULT = "1.25"


def first_match(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """EVALUATE: the value of the first rule whose condition holds."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def looked_up(key: Column, entries: dict, default, kind: str) -> Column:
    """SEARCH of a table fixed in the program: the entry of the key, or the default branch."""
    pairs = [x for k, v in entries.items() for x in (F.lit(k), F.lit(str(v)).cast(kind))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(str(default)).cast(kind))


def customer_tier(score: Column) -> Column:
    return first_match([(score >= 800, F.lit("A")), (score >= 700, F.lit("B")), (score >= 600, F.lit("C")), (score >= 500, F.lit("D"))], F.lit("E"))


def default_probability(days_past_due: Column, score: Column) -> tuple[Column, Column]:
    """Segment and probability of default."""
    rate = lambda x: F.lit(x).cast("decimal(5,4)")
    cases = [
        (days_past_due > 90, "DEFAULT", "1.0000"),
        ((days_past_due > 30) & (score < 500), "HIGH", "0.1500"),
        (score >= 750, "LOW", "0.0100"),
    ]
    return first_match([(c, F.lit(s)) for c, s, _ in cases], F.lit("MEDIUM")), first_match([(c, rate(p)) for c, _, p in cases], rate("0.0500"))


def exposure_band(pd: Column) -> Column:
    return first_match([(pd >= 1, F.lit("DEFAULTED")), (pd >= F.lit("0.15").cast("decimal(5,4)"), F.lit("SUBSTANDARD")), (pd >= F.lit("0.05").cast("decimal(5,4)"), F.lit("WATCH"))], F.lit("PERFORMING"))


def split_valid(df: DataFrame, reasons: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid rows, rejected rows with the first reason that holds, and counts: one flag column, read by three outputs."""
    marked = df.withColumn("reject_reason", first_match([(cond, F.lit(name)) for name, cond in reasons], F.lit(None).cast("string")))
    valid = marked.where("reject_reason is null").drop("reject_reason")
    error = marked.where("reject_reason is not null")
    counts = marked.agg(F.count("*").alias("n_read"), F.count_if(F.col("reject_reason").isNull()).alias("n_valid"), F.count_if(F.col("reject_reason").isNotNull()).alias("n_error"))
    return valid, error, counts


def prefer(first: Column, second: Column) -> Column:
    """The first value unless it is blank, else the second."""
    return F.coalesce(F.nullif(F.trim(first), F.lit("")), second)
