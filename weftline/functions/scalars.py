"""Scalar functions of the described programs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A quoted literal; a doubled quote inside one belongs to it. Possessive, so that long ones do not recurse.
LITERAL = "'(?:[^']++|'')*+'|\"[^\"]*+\""


#: What could be taken for an end or a separator inside a literal, and the private characters that stand for it there.
GUARD, GUARDED = " ;,()\n\r\t", "\ue001\ue002\ue003\ue004\ue005\ue006\ue007\ue008"


def without_literals(text: Column) -> Column:
    """Quoted literals taken out."""
    return F.regexp_replace(text, LITERAL, "")


def blank_literals(text: Column) -> Column:
    """Quoted literals overwritten by blanks, so that offsets stay: pieces outside keep, inside become spaces."""
    found = F.regexp_extract_all(text, F.lit(f"({LITERAL}|[^'\"]++|['\"])"), F.lit(1))
    blank = lambda x: F.when(x.rlike("^['\"].+"), F.repeat(F.lit(" "), F.length(x))).otherwise(x)
    return F.array_join(F.transform(found, blank), "")


def split_top(text: Column, separator: str = ",") -> Column:
    """Trimmed parts between separators outside parentheses, however deep; quoted literals are to be guarded before."""
    tokens = F.regexp_extract_all(text, F.lit(rf"([(){separator}]|[^(){separator}]++)"), F.lit(1))
    zero = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(acc, x):
        here, n = acc["parts"], F.size(acc["parts"])
        longer = F.concat(F.slice(here, 1, n - 1), F.array(F.concat(F.element_at(here, -1), x)))
        parts = F.when((x == separator) & (acc["depth"] <= 0), F.concat(here, F.array(F.lit("")))).otherwise(longer)
        return F.struct((acc["depth"] + (x == "(").cast("int") - (x == ")").cast("int")).alias("depth"), parts.alias("parts"))

    return F.filter(F.transform(F.aggregate(tokens, zero, step)["parts"], lambda x: F.trim(x)), lambda x: x != "")


def once(x: Column) -> Column:
    """A costly value as a generated column of one row, which Spark takes over as it stands; a plain column is worked out again for each filter and use."""
    return F.explode(F.array(x))


def clauses(text: Column, words: str) -> Column:
    """The parts of a statement that begin with keywords (alternatives of a pattern) outside parentheses: key, text; what comes first has no key."""
    # what lies between two keywords or parentheses is one token, so a fold takes few steps
    tokens = F.regexp_extract_all(text, F.lit(rf"(\b(?:{words})\b|[()]|(?:(?!\b(?:{words})\b)[^()\s]++|\s++)++)"), F.lit(1))
    part = lambda key, x: F.struct(key.alias("key"), x.alias("text"))
    zero = F.struct(F.lit(0).alias("depth"), F.array(part(F.lit(""), F.lit(""))).alias("parts"))

    def step(acc, x):
        here, n = acc["parts"], F.size(acc["parts"])
        last = F.element_at(here, -1)
        longer = F.concat(F.slice(here, 1, n - 1), F.array(part(last["key"], F.concat(last["text"], x))))
        parts = F.when((acc["depth"] <= 0) & x.rlike(rf"^(?:{words})$"), F.concat(here, F.array(part(x, F.lit(""))))).otherwise(longer)
        return F.struct((acc["depth"] + (x == "(").cast("int") - (x == ")").cast("int")).alias("depth"), parts.alias("parts"))

    return F.transform(F.aggregate(tokens, zero, step)["parts"], lambda p: part(p["key"], F.trim(p["text"])))


def truncated(x: Column, precision: int, scale: int) -> Column:
    """A COMPUTE without ROUNDED: digits beyond the target's scale are cut off, not rounded."""
    factor = F.lit(10**scale).cast("decimal(18,0)")
    whole = F.when(x < 0, F.ceil(x * factor)).otherwise(F.floor(x * factor))
    return (whole.cast("decimal(28,0)") / factor).cast(f"decimal({precision},{scale})")


def rounded(x: Column, precision: int, scale: int) -> Column:
    """A COMPUTE with ROUNDED: halves go away from zero."""
    return F.round(x, scale).cast(f"decimal({precision},{scale})")


def pic_symbols(pic: Column) -> Column:
    """A picture with its repeats counted out as ``symbol:count`` pairs, and its number of characters that take storage."""
    return F.regexp_extract_all(F.upper(pic), F.lit(r"([A-Z0-9+\-.,/*$](?:\(\d+\))?)"), F.lit(1))


def _count(symbol: Column) -> Column:
    n = F.regexp_extract(symbol, r"\((\d+)\)", 1)
    return F.when(n == "", F.lit(1)).otherwise(F.try_to_number(n, F.lit("999999"))).cast("int")


def pic_length(pic: Column, usage: Column) -> Column:
    """Bytes that a picture takes under a usage.

    Display: each symbol one byte but S, V and P. COMP-1 4, COMP-2 8. Packed: digits div 2 + 1.
    Binary: 2, 4 or 8 bytes for up to 4, up to 9 or more digits. CR and DB take two bytes.
    """
    symbols = pic_symbols(pic)
    total = lambda cond: F.aggregate(symbols, F.lit(0), lambda acc, s: acc + F.when(cond(F.substring(s, 1, 1)), _count(s)).otherwise(F.lit(0)))
    digits = total(lambda c: c == "9")
    shown = total(lambda c: ~c.isin("S", "V", "P"))
    u = F.upper(F.coalesce(usage, F.lit("DISPLAY")))
    return (
        F.when(u == "COMP-1", 4)
        .when(u == "COMP-2", 8)
        .when(u.isin("COMP-3", "PACKED-DECIMAL"), F.floor(digits / 2) + 1)
        .when(u.isin("COMP", "COMP-4", "COMP-5", "BINARY"), F.when(digits <= 4, 2).when(digits <= 9, 4).otherwise(8))
        .otherwise(shown)
        .cast("int")
    )


def clipped(text: Column, n: int) -> Column:
    """Evidence texts are kept to a stated length, with their literals as they were."""
    return F.left(F.translate(text, GUARDED, " ;,()   "), F.lit(n))


def zero_on_overflow(x: Column, precision: int, scale: int) -> Column:
    """ON SIZE ERROR: a value that the target cannot hold becomes 0."""
    limit = F.lit(10 ** (precision - scale)).cast("decimal(28,0)")
    return F.when(F.abs(x) < limit, x).otherwise(F.lit(0)).cast(f"decimal({precision},{scale})")
