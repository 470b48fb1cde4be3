"""Phrase collocation mining by Apriori level-wise passes.

A pass counts the phrases of k words. A phrase is emitted only where the two phrases of k - 1 words
that overlap in it are both frequent; they are known to every task from a broadcast bitmap of the
frequent phrases' hashes. The bitmap has a fixed largest size (``MOST_BITS``); where frequent phrases
outgrow it, more infrequent ones pass it, which costs rows and drops none, since the exact counts
that follow decide. Words and pairs are counted over the whole texts. A longer phrase stands within a
stretch of frequent pairs, so one more pass takes these stretches out of the texts, adds up equal
ones, and the later levels count in them. Before such a level is counted, a pass adds up its phrases in
counters picked by hash (a sketch of fixed size, as its bitmap is): a phrase whose counter stays below the
least count can't be frequent and is not emitted. Counters that phrases share only let more of them pass.

A task cuts and hashes a block of text in numpy and adds up its phrases before it emits any; Spark adds
up the blocks, and the tables of the levels are kept in the shared folder. Within a block, words are
told apart by two 64-bit hashes; Spark groups by the phrases themselves. Candidates are scored by joins
with the level tables: both parts of every cut of a phrase are frequent, so both are there.

Defined cases: null texts and texts without words count nothing; a null language is ``und``; ids
are not read, so repeated rows count as often as they stand; a text longer than a block is cut between
words, and what the parts share for the phrases across their border is counted once; other columns
are ignored; an empty table gives no rows. Phrases are joined by spaces, which no word holds.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, materialise

#: Words of the longest phrase, and the count from which a phrase is frequent.
LONGEST, LEAST = 5, 100
#: Rows returned for each language; percentage of its count at which a longer phrase stands for a shorter.
TOP, COVERED = 2000, 100

#: Bytes of text that a task counts at once, and that it hashes at once.
BLOCK_BYTES, STRETCH_BYTES = 8 << 20, 1 << 20
#: Bits of the bitmap for each frequent phrase, and at most (32 MB).
BITS_EACH, MOST_BITS = 64, 1 << 28
#: Bits of the number of a sketch's counters, and of those that make one row of it.
SKETCH_BITS, SKETCH_ROW_BITS = 24, 14
#: Parts that a language's candidates are ranked in before its best are ranked together.
RANK_PARTS = 64

#: Bytes that end a piece become BREAK, which no UTF-8 text holds; tabs are spaces; A-Z are lowered.
BREAK = b"\xff"
_FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", BREAK * 10 + b" abcdefghijklmnopqrstuvwxyz")

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PRIME = 0x100000001B3  # odd, so it has an inverse modulo 2^64


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier, and of its inverse."""
    back = pow(_PRIME, -1, 1 << 64)
    return tuple(np.cumprod(np.array([1] + [x] * (n - 1), np.uint64), dtype=np.uint64) for x in (_PRIME, back))


@functools.cache
def _byte_values() -> np.ndarray:
    """Two random-looking 64-bit values of each byte."""
    x = np.arange(1, 513, dtype=np.uint64) * _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).reshape(2, 256)


class Words(NamedTuple):
    """Words of a block: where each begins and ends, its piece, and two hashes."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    hash: np.ndarray
    check: np.ndarray


def words_of(folded: bytes) -> Words:
    """The words of folded text; a word's hash is a polynomial of its bytes, from running sums over a stretch."""
    data = np.frombuffer(folded, np.uint8)
    breaks = data == BREAK[0]
    edges = np.diff((breaks | (data == 32)).view(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    piece = np.cumsum(breaks, dtype=np.int32)[start]
    hashes = np.zeros((2, len(start)), np.uint64)
    up, down = _powers(STRETCH_BYTES)
    for at in range(0, len(data), STRETCH_BYTES):
        part = data[at : at + STRETCH_BYTES]
        first, last = np.searchsorted(end, at, "right"), np.searchsorted(start, at + len(part))
        if first == last:
            continue
        low, high = np.maximum(start[first:last] - at, 0), np.minimum(end[first:last] - at, len(part))
        for values, out in zip(_byte_values(), hashes, strict=True):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * up[: len(part)], out=sums[1:])
            own = (sums[high] - sums[low]) * down[low]
            if start[first] < at:  # a word that began in an earlier stretch
                own[:1] *= np.uint64(pow(_PRIME, int(at - start[first]), 1 << 64))
            out[first:last] += own
    return Words(start, end, piece, hashes[0], hashes[1])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words at each place, from hashes of the words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * _STEP + words[j : j + n]
    return out


def slots(grams: np.ndarray, lang: str, bits: int) -> np.ndarray:
    """Places of hashed phrases of a language in a bitmap of 2^bits bits."""
    mixed = (grams ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) * _STEP
    return (((mixed ^ (mixed >> np.uint64(32))) * _STEP) >> np.uint64(64 - bits)).astype(np.int64)


def marked(bitmap: np.ndarray, grams: np.ndarray, lang: str) -> np.ndarray:
    """Which of the phrases the bitmap holds."""
    slot = slots(grams, lang, int(len(bitmap) * 8).bit_length() - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def grouped(keys: np.ndarray, checks: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct pair of a key and a check, and its summed weight."""
    order = np.argsort(keys, kind="stable")
    key, check = keys[order], checks[order]
    if ((check[1:] != check[:-1]) & (key[1:] == key[:-1])).any():  # two of one key
        order = np.lexsort((checks, keys))
        key, check = keys[order], checks[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    starts = np.flatnonzero(new)
    return order[starts], np.diff(np.append(starts, len(key))) if weights is None else np.add.reduceat(weights[order], starts)


Rows = tuple[list[bytes], np.ndarray]


def places_of(words: Words, lang: str, k: int, bitmap: np.ndarray | None) -> np.ndarray:
    """Where k words of one piece begin whose phrases of k - 1 words are both in the bitmap."""
    if k == 1 or len(words.start) < k:
        return np.arange(len(words.start) if k == 1 else 0)
    known = marked(bitmap, gram_hashes(words.hash, k - 1), lang)
    return np.flatnonzero(known[:-1] & known[1:] & (words.piece[: len(words.piece) - k + 1] == words.piece[k - 1 :]))


def count_block(folded: bytes, lang: str, k: int, bitmap: np.ndarray | None, weights: tuple[np.ndarray, np.ndarray] | None = None, likely: np.ndarray | None = None) -> Rows:
    """Phrases of k words with their counts, where both phrases of k - 1 words are in the bitmap; with words, also their number, as the empty phrase.

    ``weights`` are the ends of the block's rows and what each counts, 1 if there are none. With ``likely``, only the phrases in that bitmap.
    """
    words = words_of(folded)
    at = places_of(words, lang, k, bitmap)
    if likely is not None and len(at):
        at = at[marked(likely, gram_hashes(words.hash, k)[at], lang)]
    if not len(at):
        return [], np.zeros(0, np.int64)
    each = None if weights is None else weights[1][np.searchsorted(weights[0], words.start[at], "right")]
    first, counts = grouped(gram_hashes(words.hash, k)[at], gram_hashes(words.check, k)[at], each)
    first = at[first]
    start, end = (np.stack([x[first + j] for j in range(k)], 1).tolist() for x in (words.start, words.end))
    if k == 1:
        return [b"", *(folded[a:b] for (a,), (b,) in zip(start, end, strict=True))], np.append(counts.sum(), counts)
    return [b" ".join([folded[a:b] for a, b in zip(x, y, strict=True)]) for x, y in zip(start, end, strict=True)], counts


def stretches_of(folded: bytes, lang: str, bitmap: np.ndarray) -> Rows:
    """Longest stretches of three words or more whose pairs are all in the bitmap, with their number."""
    words = words_of(folded)
    pair = marked(bitmap, gram_hashes(words.hash, 2), lang) & (words.piece[:-1] == words.piece[1:])
    edges = np.diff(pair.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    own = last - first >= 2
    found: dict[bytes, int] = {}
    for a, b in zip(words.start[first[own]].tolist(), words.end[last[own]].tolist(), strict=True):
        text = b" ".join(folded[a:b].split())
        found[text] = found.get(text, 0) + 1
    return list(found), np.fromiter(found.values(), np.int64, len(found))


class Blocks:
    """Gathers a task's texts by language in blocks and emits what ``count`` makes of each; a long text is cut between words.

    Both parts of a cut hold the ``shared`` words before it; what these give alone is taken off again.
    """

    def __init__(self, count: Callable[[bytes, str, tuple[np.ndarray, np.ndarray] | None], Rows], shared: int, weighted: bool, block_bytes: int):
        self.count, self.shared, self.weighted, self.block_bytes = count, shared, weighted, block_bytes
        self.parts: dict[str, list[tuple[bytes, int]]] = {}
        self.size = 0

    def add(self, lang: str, data: bytes, weight: int = 1) -> Iterator[pa.RecordBatch]:
        at, before = 0, b""
        while True:
            stop = data.find(b" ", at + self.block_bytes) if len(data) - at > self.block_bytes else -1
            part = before + data[at : len(data) if stop < 0 else stop].translate(_FOLD)
            self.parts.setdefault(lang, []).append((part, weight))
            self.size += len(part) + 64
            if stop < 0:
                break
            before = b"".join(b" " + w for w in part.rsplit(None, self.shared)[-self.shared :]) if self.shared else b""
            if self.weighted:
                self.parts[lang].append((before, -weight))
            yield from self.flush()
            if before and not self.weighted:
                yield from self.emit(lang, before, None, -weight)
            at = stop
        if self.size >= self.block_bytes:
            yield from self.flush()

    def all_of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = batch.column(2) if self.weighted else [None] * batch.num_rows
            for lang, data, weight in zip(batch.column(0), batch.column(1), weights, strict=True):
                yield from self.add(lang.as_py(), data.as_py(), weight.as_py() if self.weighted else 1)
        yield from self.flush()

    def emit(self, lang: str, folded: bytes, weights: tuple[np.ndarray, np.ndarray] | None, sign: int = 1) -> Iterator[pa.RecordBatch]:
        phrases, counts = self.count(folded, lang, weights)
        if phrases:
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(phrases)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts * sign, pa.int64())], ["lang", "phrase", "a"])

    def flush(self) -> Iterator[pa.RecordBatch]:
        parts, self.parts, self.size = self.parts, {}, 0
        for lang, rows in parts.items():
            weights = (np.cumsum([len(x) + 1 for x, _ in rows]), np.array([w for _, w in rows], np.int64)) if self.weighted else None
            yield from self.emit(lang, BREAK.join(x for x, _ in rows), weights)


def add_to_sketch(sketch: np.ndarray, least: int, k: int, folded: bytes, lang: str, bitmap: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> Rows:
    """Adds the phrases that ``count_block`` would emit to the sketch, each counter up to ``least``; emits none.

    What cut texts share is not taken off here, so a counter is never below its phrases' true count.
    """
    words = words_of(folded)
    at = places_of(words, lang, k, bitmap)
    if len(at):
        each = np.maximum(weights[1][np.searchsorted(weights[0], words.start[at], "right")], 0)
        slot, own = np.unique(slots(gram_hashes(words.hash, k)[at], lang, len(sketch).bit_length() - 1), return_inverse=True)
        sketch[slot] = np.minimum(sketch[slot] + np.bincount(own, each), least)
    return [], np.zeros(0, np.int64)


def likely_phrases(texts: DataFrame, k: int, bitmap: np.ndarray, least: int, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """A bitmap of 2^SKETCH_BITS bits that holds every phrase of k words which ``texts`` (lang, data, a) have ``least`` times or more."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)
    row, kind = 1 << SKETCH_ROW_BITS, np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, kind)
        blocks = Blocks(lambda *block: add_to_sketch(sketch, least, k, block[0], block[1], sent.value, block[2]), k - 1, True, block_bytes)
        yield from blocks.all_of(batches)
        rows = sketch.reshape(-1, row)
        for at in np.flatnonzero(rows.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([rows[at].tobytes()], pa.binary())], ["at", "counts"])

    def summed(rows: pa.Table) -> pa.Table:
        total = np.zeros(row, np.int64)
        for counts in rows.column("counts"):
            total += np.frombuffer(counts.as_py(), kind)
        return pa.table({"at": rows.column("at").slice(0, 1).cast(pa.int32()), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    found = map_arrow(texts, run, "at int, counts binary").groupBy("at").applyInArrow(summed, "at int, bits binary").toArrow()
    out = np.zeros((1 << (SKETCH_BITS - SKETCH_ROW_BITS), row >> 3), np.uint8)
    for at, bits in zip(found.column("at").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[at] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def in_blocks(texts: DataFrame, count: Callable, bitmap: np.ndarray | None, shared: int, weighted: bool = False, block_bytes: int = BLOCK_BYTES, likely: np.ndarray | None = None) -> DataFrame:
    """lang, phrase and its count a, added up over all blocks; ``texts`` has lang, data (bytes) and, if ``weighted``, a."""
    sent = texts.sparkSession.sparkContext.broadcast((bitmap, likely))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(lambda folded, lang, weights: count(folded, lang, *sent.value, weights), shared, weighted, block_bytes)
        yield from blocks.all_of(batches)

    return map_arrow(texts, run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def bitmap_of(frequent: DataFrame, k: int) -> np.ndarray | None:
    """The bitmap of the frequent phrases of k words, None if there are none. Its words are or-ed in Spark; at most MOST_BITS / 64 of them come to the driver."""
    n = frequent.count()
    if not n:
        return None
    bits = min(MOST_BITS.bit_length() - 1, max(10, (n * BITS_EACH - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs.tolist()):
                words = words_of(BREAK.join(p.encode() for p in batch.filter(pa.array(langs == lang)).column(1).to_pylist()))
                slot = slots(gram_hashes(words.hash, k)[::k], lang, bits)
                yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.int64(1) << (slot & 63))], ["word", "bits"])

    rows = map_arrow(frequent.select("lang", "phrase"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def levels(docs: DataFrame, longest: int, least: int, lang_col: str = "lang", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of one to ``longest`` words (lang, phrase, k, a), and all words' number of each language (lang, n)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("data")).where("data is not null")
    level = materialise(in_blocks(texts, functools.partial(_count_level, 1), None, 0, block_bytes=block_bytes).where((F.col("a") >= least) | (F.col("phrase") == "")), "phrases-1")
    n = level.where("phrase = ''").select("lang", F.col("a").alias("n"))
    found = [level.where("phrase != ''")]
    for k in range(2, longest + 1):
        bitmap = bitmap_of(found[-1], k - 1)
        if bitmap is None:
            break
        if k == 3:
            runs = in_blocks(texts, lambda data, lang, bitmap, likely, w: stretches_of(data, lang, bitmap), bitmap, longest - 1, block_bytes=block_bytes)
            texts = materialise(runs.where("a != 0").select("lang", F.col("phrase").cast("binary").alias("data"), "a"), "stretches")
        likely = likely_phrases(texts, k, bitmap, least, block_bytes) if k > 2 else None
        counted = in_blocks(texts, functools.partial(_count_level, k), bitmap, k - 1, weighted=k > 2, block_bytes=block_bytes, likely=likely)
        found.append(materialise(counted.where(F.col("a") >= least), f"phrases-{k}"))
    return functools.reduce(DataFrame.unionAll, (f.select("lang", "phrase", F.lit(k + 1).alias("k"), "a") for k, f in enumerate(found))), n


def _count_level(k: int, data: bytes, lang: str, bitmap: np.ndarray, likely: np.ndarray | None, weights: tuple[np.ndarray, np.ndarray] | None) -> Rows:
    return count_block(data, lang, k, bitmap, weights, likely)


def cut_scores(frequent: DataFrame, n: DataFrame) -> DataFrame:
    """Candidates (two words or more) with the cut of the lowest score: lang, phrase, k, a, l, r, n, score."""
    cuts = (
        frequent.where("k > 1")
        .withColumn("words", F.split("phrase", " "))
        .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
        .select("lang", "phrase", "k", "a", "cut", F.array_join(F.slice("words", 1, F.col("cut")), " ").alias("left"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k")), " ").alias("right"))
    )
    parts = frequent.select("lang", "phrase", "a")
    scored = (
        cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
        .join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
        .join(n, "lang")
        # products of counts pass 64 bits
        .withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(18,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    )
    least = F.min(F.struct("score", "cut", "l", "r")).alias("at")
    return scored.groupBy("lang", "phrase", "k", "a", "n").agg(least).select("lang", "phrase", "k", "a", "at.l", "at.r", "n", "at.score")


def uncovered(candidates: DataFrame, percent: int = COVERED) -> DataFrame:
    """The candidates less those inside a longer one with at least ``percent`` of their count."""
    inner = (
        candidates.where("k > 2")
        .withColumn("words", F.split("phrase", " "))
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
        .groupBy("lang", F.array_join(F.slice("words", F.col("start"), F.col("size")), " ").alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    return candidates.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first rows by score, count and phrase. Parts of a language are cut first, so no task sorts all of it."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED, lang_col: str = "lang", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    frequent, n = levels(docs, longest, least, lang_col, text_col, block_bytes)
    candidates = materialise(cut_scores(frequent, n), "cuts")
    return best(uncovered(candidates, covered), top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The query's DuckDB form.
COLLOCATIONS_SQL = r"""
WITH folded AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS piece, p FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM folded)),
words AS (SELECT lang, piece, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces)),
runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM words WINDOW o AS (PARTITION BY lang, piece ORDER BY pos)),
counted AS (
  SELECT lang, [w1] AS p, count(*) AS a FROM runs GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM runs WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE len(p) = 1 GROUP BY lang),
f AS (SELECT lang, p, a FROM counted WHERE a >= 100),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:] JOIN total t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, p[s:s + z - 1] AS p, max(a) AS most
  FROM (SELECT lang, p, a, z, unnest(range(1, len(p) - z + 2)) AS s FROM (SELECT lang, p, a, unnest(range(2, len(p))) AS z FROM f WHERE len(p) > 2))
  GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM lowest b LEFT JOIN longer g ON g.lang = b.lang AND g.p = b.p WHERE g.most IS NULL OR 100 * g.most < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
