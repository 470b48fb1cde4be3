"""Sorting fixed-width records by typed byte ranges, with each record's position in the whole order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.session import settled

#: A zoned number's last byte, by its digit: without sign, positive, negative.
ZONED = ("0123456789", "{ABCDEFGHI", "}JKLMNOPQR")
#: Formats of a key: text, zoned, packed, unsigned and signed binary.
FORMATS = ("CH", "ZD", "PD", "BI", "FI")

Key = tuple[int, int, str, str]  # start from 1, bytes, format, A or D


def key_list(card: str) -> list[Key]:
    """Keys of ``SORT FIELDS=(start,length[,format],order, …)[,FORMAT=f]``; the card is stated by the caller, not data."""
    default = re.search(r"\bFORMAT=(\w\w)", card)
    body = re.search(r"FIELDS=\(([^)]*)\)", card)
    if not body:
        raise ValueError(f"no FIELDS in {card!r}")
    text = re.sub(r"\s", "", body[1])
    found = re.findall(r"(\d+),(\d+)(?:,([A-Z]{2}))?,([AD])(?:,|$)", text)
    keys = [(int(at), int(n), f or (default[1] if default else ""), order) for at, n, f, order in found]
    if not keys or ",".join(",".join(filter(None, k)) for k in found) != text or any(k[2] not in FORMATS or not k[0] or not k[1] for k in keys):
        raise ValueError(f"can't read the keys of {card!r}")
    return keys


def _signed(digits: Column, negative: Column) -> Column:
    """Digits behind a letter for the sign, those of negative numbers complemented, as hexadecimal text; both zeros are one."""
    low = negative & digits.rlike("[1-9]")
    return F.hex(F.when(low, F.concat(F.lit("N"), F.translate(digits, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("P"), digits)).cast("binary"))


def _piece(record: Column, key: Key) -> Column:
    at, n, kind, order = key
    raw = F.rpad(F.hex(F.substring(record, at, n)), 2 * n, "0")
    if kind == "FI":
        out = F.concat(F.translate(F.left(raw, F.lit(1)), "0123456789ABCDEF", "89ABCDEF01234567"), F.substring(raw, 2, 2 * n - 1))
    elif kind == "PD":
        # a malformed number comes before all others, in the order of its bytes
        number = _signed(F.left(raw, F.lit(2 * n - 1)), F.right(raw, F.lit(1)).isin("B", "D"))
        out = F.when(raw.rlike("^[0-9]+[A-F]$"), number).otherwise(F.rpad(F.concat(F.lit("00"), raw), 4 * n, "0"))
    elif kind == "ZD":
        text = F.unhex(raw).cast("string")
        last = F.right(text, F.lit(1))
        digits = F.concat(F.left(text, F.lit(n - 1)), F.translate(last, "".join(ZONED), ZONED[0] * 3))
        ends = "|".join(f"{ord(c):02X}" for c in "".join(ZONED))
        out = F.when(raw.rlike(f"^(?:3[0-9]){{{n - 1}}}(?:{ends})$"), _signed(digits, last.isin(*ZONED[2]))).otherwise(F.concat(F.lit("00"), raw))
    else:
        out = raw
    return F.translate(out, "0123456789ABCDEF", "FEDCBA9876543210") if order == "D" else out


def sort_key(record: Column | str, keys: list[Key]) -> Column:
    """One binary key whose byte order is the order of the keys of a record (text counts as UTF-8 bytes).

    Every key takes a fixed number of bytes. Bytes that a short record lacks count as zeros; malformed packed
    and zoned numbers come before well-formed ones (after them, if descending); a null record has a null key.
    """
    record = (F.col(record) if isinstance(record, str) else record).cast("binary")
    return F.unhex(F.concat(*[_piece(record, k) for k in keys]))


def numbered(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Rows with their position from 1 in the whole order, which no task sees as a whole.

    Rows are dealt by ranges of ``order`` and sorted in their range; a range's first position is the number of
    rows in the ranges before it. Only the sizes of the ranges, one row for each, meet in one task. Rows that agree in all of ``order`` fall
    into one range, so end it with columns that tell rows apart, which split a hot key too.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settled(dealt.select("*", F.spark_partition_id().alias("range_"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at_")))
    before = W.Window.orderBy("range_").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = placed.groupBy("range_").agg(F.count("*").alias("n_")).select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    return placed.join(F.broadcast(sizes), "range_").withColumn(name, F.col("before_") + F.col("at_") + 1).drop("range_", "at_", "before_")  # a row for each shuffle partition


def sort_records(df: DataFrame, record: str, card: str, ties: list[str]) -> DataFrame:
    """The SORT card over a column of records: ``pos`` from 1; records with equal keys stand in the order of ``ties``."""
    return numbered(df.withColumn("key_", sort_key(record, key_list(card))), [F.col("key_"), *map(F.col, ties)]).drop("key_")


def built(record: Column | str, ranges: list[tuple[int, int]]) -> Column:
    """BUILD of a text record: byte ranges (start, length) one after another."""
    raw = (F.col(record) if isinstance(record, str) else record).cast("binary")
    return F.concat(*[F.rpad(F.substring(raw, at, n), n, F.lit(b" ")) for at, n in ranges]).cast("string")
