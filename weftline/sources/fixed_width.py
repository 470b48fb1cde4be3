"""Fixed-width records: layouts with byte offsets, encoding, decoding, packed decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

Layout = list[tuple[str, int, str]]  # field, bytes, "text" or "number"


def offsets(fields: DataFrame) -> DataFrame:
    """Start (from 1) and end of each field of a record: running sums of lengths. fields: record, ord, field, length."""
    upto = W.Window.partitionBy("record").orderBy("ord").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    end = F.sum("length").over(upto)
    return fields.select("record", "ord", "field", "length", (end - F.col("length") + 1).alias("start"), end.alias("end"))


def encode(layout: Layout) -> Column:
    """One line: text left-aligned and padded by blanks, numbers right-aligned and padded by zeros."""
    parts = [F.rpad(F.col(f).cast("string"), n, " ") if kind == "text" else F.lpad(F.col(f).cast("string"), n, "0") for f, n, kind in layout]
    return F.concat(*parts)


def decode(line: Column, layout: Layout) -> list[Column]:
    """Columns of a line: text without trailing blanks, numbers by try_cast, so that a bad field is null."""
    out, at = [], 1
    for f, n, kind in layout:
        piece = F.substring(line, at, n)
        out.append((F.rtrim(piece) if kind == "text" else F.trim(piece).try_cast("bigint")).alias(f))
        at += n
    return out


def layout_gaps(declared: DataFrame, fields: DataFrame) -> DataFrame:
    """Records whose fields do not add up to the declared length. declared: record, length."""
    total = offsets(fields).groupBy("record").agg(F.max("end").alias("laid_out"))
    return declared.join(total, "record").where("length <> laid_out")


def unpacked(data: Column | str) -> Column:
    """Packed decimal (two digits a byte, sign in the last half-byte) as a whole number of up to 18 digits; malformed bytes give null."""
    digits = F.lower(F.hex(data))
    number = F.substr(digits, F.lit(1), F.length(digits) - 1).try_cast("decimal(18,0)")
    return F.when(digits.rlike("^[0-9]+[a-f]$"), F.when(digits.rlike("[bd]$"), -number).otherwise(number)).cast("decimal(18,0)")


def packed(number: Column, size: int) -> Column:
    """A whole number as packed decimal of ``size`` bytes."""
    digits = F.lpad(F.abs(number).cast("string"), 2 * size - 1, "0")
    return F.unhex(F.concat(digits, F.when(number < 0, "d").otherwise("c")))


def zoned(number: Column, size: int) -> Column:
    """A whole number as zoned decimal text of ``size`` digits, the sign over the last one."""
    digits = F.lpad(F.abs(number).cast("string"), size, "0")
    last = F.right(digits, F.lit(1))
    return F.concat(F.left(digits, F.lit(size - 1)), F.when(number < 0, F.translate(last, "0123456789", "}JKLMNOPQR")).otherwise(F.translate(last, "0123456789", "{ABCDEFGHI")))


def binary_number(number: Column, size: int) -> Column:
    """A whole number as ``size`` bytes, the highest first, negative ones as two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit(2 * size)))
