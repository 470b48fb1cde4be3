"""Fill-in-the-middle transformation: a text is cut at two units and its parts are put in another order.

An Arrow-batched pandas UDF cuts each whole text: the ends of its units (a word with the white
space before it, or white space at the end) are collected from the ``regex`` library's matches in
a compact array, so a cut is one look-up there and one slice of the text. The two cuts and the
form come from a sha256 of the seed and the row's id, so reruns agree and rows do not depend on
each other.

Forms: ``psm`` is prefix, suffix, middle; ``spm`` is suffix, prefix, middle; ``plain`` is the text
as it is. Texts that hold a mark of their own stay plain, so that ``restore`` is exact.

Defined cases: a null text counts as empty, and an empty text stays plain; a null id counts as an
empty one; rows with equal ids are cut alike, each in its own text; a text of any length takes four
bytes for each unit beside itself; other columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of a text, and the marks before its parts.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Seed; percentages of texts that are cut, and of those in the form spm.
SEED, RATE, SPM_RATE = 42, 50, 80

_units = regex.compile(UNIT).finditer
_end = methodcaller("end")


def unit_ends(text: str) -> array:
    """The end of each unit, in code points."""
    return array("I", map(_end, _units(text)))


def draws(row_id: str, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers of a row."""
    digest = hashlib.sha256(f"{seed}:{row_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def transform(row_id: str, text: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, int, str, int | None, int | None]:
    """The output of a text, its number of units, its form, and the code points of prefix and middle (None if plain)."""
    ends = unit_ends(text)
    h1, h2, h3, h4 = draws(row_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return text, len(ends), "plain", None, None
    first, second = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", len(ends), "spm", a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", len(ends), "psm", a, b - a


def restore(output: str, form: str) -> str:
    """The text of an output. No mark starts inside another, so the first place of each is its own."""
    if form == "plain":
        return output
    outer, inner = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    first, rest = output.removeprefix(outer).split(inner, 1)
    second, middle = rest.split(MIDDLE, 1)
    return second + middle + first if form == "spm" else first + middle + second


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, keep_text: bool = True) -> DataFrame:
    """Every row's id, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, with ``keep_text``, the output."""
    schema = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * keep_text

    names = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = []
            for row_id, text in zip(ids, texts, strict=True):
                output, n, form, prefix, middle = transform(row_id, text, seed, rate, spm_rate)
                row = (n, form, prefix, middle, _sha(output), _sha(restore(output, form)))
                rows.append((*row, output) if keep_text else row)
            made = pd.DataFrame(rows, columns=names)
            yield made.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    made = cut(F.coalesce(F.col(id_col).cast("string"), F.lit("")), whole).alias("made_")
    return docs.select(F.col(id_col), made).select(id_col, "made_.*")


#: The query's DuckDB form.
FILL_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM texts),
parts AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS prefix, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix
  FROM drawn),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                 ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN split_part(split_part(output, '<P>', 2), '<S>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
              ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<P>', 1) END) AS restored_sha256
FROM made
"""
