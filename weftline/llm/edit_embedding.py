"""Document fingerprints by a randomised edit embedding.

A walk shared by all texts reads a text character by character: at output step ``j`` it
repeats the current character and moves on if the random bit ``r(j, character)`` is set, so a
few edits leave most output positions alike (edit distance becomes Hamming distance). From
the output, ``SLOTS`` positions are sampled: slot ``k`` takes the position below the output's
length with the least random priority, which texts of nearly equal length nearly always
share. A slot keeps eight hashed bits of its position and character; the fingerprint is the
slots in hex. The likeness of two fingerprints is the share of equal slots. For near-duplicate
search, fingerprints are cut into bands of sampled slots; texts that share a band are
candidates, verified by their likeness.

Defined cases: null and empty texts have no characters and one common fingerprint; equal
texts have equal fingerprints; the next document after the last is the first, and a lone
document is its own next; equal ids are ordered by a hash of their text, then by text; a null
id comes first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches, materialise

SLOTS = 64
BAND_SLOTS = 4
#: Classes of a band that are compared within one block; larger bands are dealt as pairs of blocks.
BAND_BLOCK = 256
PERIOD = 4096  # of the random bits
CLASSES = 256
#: Documents and characters that a task holds at once in matrices, about.
CHUNK_DOCS, CHUNK_CHARS = 1024, 4_000_000


def _tables(seed: int = 29) -> tuple[np.ndarray, np.ndarray]:
    """For each class and step, the step at which the walk leaves the character; and the record positions of each slot."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (CLASSES, PERIOD)).astype(bool)
    bits[:, ::16] = True  # no character is repeated more than 16 times
    leave = np.zeros((CLASSES, PERIOD), np.int64)
    following = np.full(CLASSES, PERIOD)
    for j in range(2 * PERIOD - 1, -1, -1):
        following = np.where(bits[:, j % PERIOD], j, following)
        if j < PERIOD:
            leave[:, j] = (following + 1) % PERIOD
    # the minimum of priorities over growing ranges changes at record positions, each a random stretch after the last
    records = np.full((SLOTS, 128), np.iinfo(np.int64).max)
    for k in range(SLOTS):
        at, n = 0, 0
        while at < 1 << 40:
            records[k, n] = at
            at, n = int((at + 1) / (1 - rng.random() * 0.999999)), n + 1
    return leave.astype(np.int32).ravel(), records


LEAVE, RECORDS = _tables()
EMPTY = "00" * SLOTS


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def walk(rows: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
    """Steps (modulo PERIOD) after each character of some code arrays, from given steps, for all rows at once."""
    order = sorted(range(len(rows)), key=lambda r: -len(rows[r]))
    lengths = np.array([len(rows[r]) for r in order])
    longest = int(lengths[0]) if len(lengths) else 0
    # the k-th characters of all rows that have one lie side by side
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
    offset = np.concatenate([[0], np.cumsum(active)])
    base = np.empty(offset[-1], np.int32)
    for rank, r in enumerate(order):
        c = rows[r].astype(np.uint32)
        base[offset[: len(c)] + rank] = ((c * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int32) * PERIOD
    steps = base
    now = begin[order].astype(np.int32)
    at = offset.tolist()
    for i in range(longest):
        own = steps[at[i] : at[i + 1]]
        own += now[: len(own)]
        now = LEAVE.take(own, mode="clip")
        own[:] = now
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(rows)
    for rank, r in enumerate(order):
        out[r] = steps[offset[: len(rows[r])] + rank]
    return out


def fingerprint(text: np.ndarray, steps: np.ndarray) -> bytes:
    """Sampled bits of the walk's output over a text's codes."""
    if not len(text):
        return bytes(SLOTS)
    spent = np.diff(steps, prepend=0) % PERIOD
    ends = np.cumsum(spent)
    pos = RECORDS[np.arange(SLOTS), (RECORDS < ends[-1]).sum(1) - 1]
    char = text[np.searchsorted(ends, pos, side="right")]
    h = (char.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (pos.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(56)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


class Print:
    """A text's codes, its fingerprint, and the step of the walk after its first half."""

    def __init__(self, text: str):
        self.codes = codes(text)
        self.half = len(self.codes) - len(self.codes) // 2

    @staticmethod
    def all(prints: list[Print]) -> None:
        first = walk([p.codes[: p.half] for p in prints], np.zeros(len(prints), np.int32))
        turn = np.array([s[-1] if len(s) else 0 for s in first], np.int32)
        second = walk([p.codes[p.half :] for p in prints], turn)
        for p, a, b, t in zip(prints, first, second, turn.tolist(), strict=True):
            p.first, p.turn, p.bytes = a, t, fingerprint(p.codes, np.concatenate([a, b]))


def compare(rows: list[tuple[object, Print, Print]]) -> list[tuple]:
    """For rows of id, document and next document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    tails = [nxt.codes[: len(doc.codes) // 2] for _, doc, nxt in rows]
    walked = walk(tails, np.array([doc.turn for _, doc, _ in rows], np.int32))
    out = []
    for (doc_id, doc, nxt), tail, steps in zip(rows, tails, walked, strict=True):
        edited = np.concatenate([doc.codes[: doc.half], tail])
        own = fingerprint(edited, np.concatenate([doc.first, steps]))
        digest = hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        out.append((doc_id, len(doc.codes), digest, doc.bytes.hex(), own.hex(), likeness(doc.bytes, own), likeness(doc.bytes, nxt.bytes)))
    return out


# --- Spark jobs ------------------------------------------------------------------------

COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _record(rows: list[tuple], kind: pa.DataType, id_col: str) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [id_col, *(c.split()[0] for c in COLUMNS.split(", "))])


def _chunks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[Print]]]:
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if k + 1 == len(texts) or k + 1 - start >= CHUNK_DOCS or held >= CHUNK_CHARS:
            prints = [Print(x) for x in texts[start : k + 1]]
            Print.all(prints)
            yield ids[start : k + 1], prints
            start, held = k + 1, 0


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form: the id and COLUMNS.

    The edited text has its last ``n_chars div 2`` code points replaced by the first as many
    of the next document. Texts are dealt by ranges of the id once; only the last document of
    each partition waits for the first of the next one, by way of a written table.
    """
    spark = docs.sparkSession
    kind_ = docs.schema[id_col].dataType.simpleString()
    ordered = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"))
    ordered = ordered.repartitionByRange("id_", F.xxhash64("text_")).sortWithinPartitions("id_", F.xxhash64("text_"), "text_")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, kind = TaskContext.get().partitionId(), None, None

        def rows_of(done: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
            rec = _record(done + [(i, *[None] * 6) for i, _, _ in ends], kind, "id_")
            n = len(done)
            more = [pa.array([part] * (n + len(ends)), pa.int32()), pa.array([0] * n + [e for _, _, e in ends], pa.int32()), pa.array([None] * n + [p.codes.tobytes().decode("utf-32-le", "surrogatepass") for _, p, _ in ends], pa.string())]
            return pa.RecordBatch.from_arrays([*rec.columns, *more], [*rec.schema.names, "part_", "end_", "text_"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for ids, prints in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ends = [(ids[0], prints[0], 1)] if kept is None else []
                row = list(zip(ids, prints, strict=True))
                if kept is not None:
                    row.insert(0, kept)
                yield rows_of(compare([(i, p, row[k + 1][1]) for k, (i, p) in enumerate(row[:-1])]), ends)
                kept = row[-1]
        if kept is not None:
            yield rows_of([], [(*kept, 2)])

    made = materialise(ordered.mapInArrow(step, f"id_ {kind_}, {COLUMNS}, part_ int, end_ int, text_ string"), "prints")
    # a row for each partition comes to the driver: which one follows which
    parts = sorted(r[0] for r in made.where("end_ = 1").select("part_").collect())
    follows = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part_ int, next_ int")
    heads = made.where("end_ = 1").select(F.col("part_").alias("next_"), F.col("text_").alias("next_text_"))
    waiting = made.where("end_ = 2").select("id_", "part_", "text_").join(F.broadcast(follows), "part_").join(heads, "next_").select("id_", "text_", "next_text_")

    def make():
        def last(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text, nxt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair = [Print(text), Print(nxt)]
                Print.all(pair)
                out += compare([(doc_id, *pair)])
            return _record(out, batch.schema.field(0).type, "id_")

        return last

    names = [c.split()[0] for c in COLUMNS.split(", ")]
    out = made.where("end_ = 0").select("id_", *names).unionByName(map_batches(waiting, make, f"id_ {kind_}, {COLUMNS}"))
    return out.withColumnRenamed("id_", id_col)


def near_links(prints: DataFrame, at_least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """Verified near-duplicate links between fingerprints: class_a, class_b (class_a < class_b), likeness.

    ``prints`` has an id and ``fingerprint``. Texts of one fingerprint are a class, named by its
    fingerprint. All classes of a band are compared with each other: those of a band with more
    than BAND_BLOCK are dealt to blocks by a hash, and every pair of blocks is one group, so the
    work of a common band spreads, but grows with the square of its classes. The search is
    approximate in one way: near texts may share no band.
    """
    classes = prints.select("fingerprint").distinct()
    band = F.sequence(F.lit(0), F.lit(SLOTS // BAND_SLOTS - 1))
    keyed = classes.select("fingerprint", F.explode(band).alias("band"))
    keyed = keyed.withColumn("key", F.expr(f"concat(band, ':', substring(fingerprint, band * {2 * BAND_SLOTS} + 1, {2 * BAND_SLOTS}))")).drop("band")
    blocks = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BAND_BLOCK).alias("blocks"))
    dealt = keyed.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fingerprint"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "fingerprint", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    left = dealt.withColumnsRenamed({"fingerprint": "class_a", "own": "own_a"})
    right = dealt.withColumnsRenamed({"fingerprint": "class_b", "own": "own_b"})
    pairs = left.join(right, ["key", "lo", "hi"]).where("class_a < class_b and (lo = hi or own_a <> own_b)").select("class_a", "class_b")
    bytes_equal = F.lit(0)
    for k in range(SLOTS):
        bytes_equal = bytes_equal + (F.substring("class_a", 2 * k + 1, 2) == F.substring("class_b", 2 * k + 1, 2)).cast("int")
    return pairs.withColumn("likeness", bytes_equal / SLOTS).where(F.col("likeness") >= at_least).distinct()
