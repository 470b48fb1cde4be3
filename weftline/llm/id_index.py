"""Raw token-id shards with a minimal perfect hash index from document key to shard offset.

Layout below one folder of a file system that all executors share:

- ``ids-<shard>.bin``: the ids of the shard's documents one after another, little-endian
  unsigned 16-bit (vocabularies up to 65,536 ids) or 32-bit integers, nothing else;
- ``index-<bucket>.npz``: for the keys whose hash falls in the bucket, the bit levels of a
  minimal perfect hash and, by slot, fingerprint, shard, offset and count;
- ``shape.json``: widths, shard starts and the number of buckets.

A key is a document id with its occurrence number, so repeated ids stay apart. Documents
are written in ascending order of id (nulls first), equal ids in order of their text.

Defined cases: a null text counts as empty and holds just the end id; a null id is a key
of its own; an empty table gives no shards and an index that finds nothing; other columns
are ignored.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise

#: Keys of one index bucket on average: a bucket is built, loaded and searched by one task.
BUCKET_KEYS = 50_000
#: Bits for each key of a level.
LOAD = 1.6
#: Words that one Python worker remembers before it starts afresh.
REMEMBERED = 1_200_000
#: The null id's stand-in, told apart by the key's flag.
NULL_ID = -(1 << 63)


# --- files -----------------------------------------------------------------------------


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _put(path: str, data: bytes) -> None:
    """Write by a name of its own and then rename, so that a repeated attempt replaces a whole file."""
    fs, at = _open(path)
    own = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, at)


def _get(path: str) -> bytes:
    fs, at = _open(path)
    with fs.open_input_stream(at) as f:
        return f.read()


# --- tokenizer -------------------------------------------------------------------------


class WordEncoder:
    """Ids by a tokenizers file whose pieces never cross white space, remembered by word."""

    _made: dict[int, WordEncoder] = {}

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, text: str) -> WordEncoder:
        """One encoder for each worker process and tokenizer, so that its words stay known between tasks."""
        key = zlib.crc32(text.encode())
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(text)
        return cls._made[key]

    def _one_by_one(self, words: list[str]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[word] = np.array(e.ids, self.kind).tobytes()

    def _letters(self, words: list[str]) -> None:
        """Words of letters are one piece each: encode them together and cut after the ids that end a word."""
        rows = [words[i : i + 64] for i in range(0, len(words), 64)]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            cut = np.nonzero(self.ends[ids])[0] + 1
            if len(cut) != len(row) or cut[-1] != len(ids):
                self._one_by_one(row)
                continue
            data, w, start = ids.tobytes(), self.kind.itemsize, 0
            for word, end in zip(row, (cut * w).tolist(), strict=True):
                self.known[word] = data[start:end]
                start = end

    def _learn(self, words: set[str]) -> None:
        split, letters, rest = {}, set(), set()
        for word in words:
            low = word.lower() if word.isascii() else word
            core, last = (low[:-1], low[-1]) if low[-1] in ".,!;:" else (low, "")
            if core.isalpha():  # letters and one mark after them are separate pieces
                split[word] = (core, last)
                letters.add(core)
                rest.update(last)
            else:
                rest.add(word)
        self._letters(sorted(w for w in letters if w not in self.known))
        self._one_by_one(sorted(w for w in rest if w not in self.known))
        for word, (core, last) in split.items():
            self.known[word] = self.known[core] + (self.known[last] if last else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [t.split() if not any(c in t for c in "\x1c\x1d\x1e\x1f") else None for t in texts]  # those four are no white space to the library
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        if new := {x for x in set().union(*(w for w in words if w is not None)) if x not in known}:
            self._learn(new)
        get = known.__getitem__
        return [
            b"".join(map(get, w)) if w is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind).tobytes()
            for w, t in zip(words, texts, strict=True)
        ]


# --- minimal perfect hash --------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, is_null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    h = _mix(ids.astype(np.int64).view(np.uint64), 1)
    return _mix(h ^ _mix(occurrence.astype(np.int64).view(np.uint64), 2) ^ np.where(is_null, np.uint64(0x5851F42D4C957F2D), np.uint64(0)), 3)


class PerfectHash:
    """Levels of bits: a key whose position no other key of its level has sets that bit; its slot is the bit's rank."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, base = [], 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(base + np.cumsum(counts) - counts)
            base += int(counts.sum())
        self.base = base

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(hashes)
        while len(left) and len(levels) < 48:
            size = -(-max(64, int(LOAD * len(left))) // 64) * 64
            at = (_mix(left, 16 + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size // 64, np.uint64)
            np.bitwise_or.at(bits, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            levels.append(bits)
            left = left[~alone]
        return cls(levels, np.sort(left))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; of a hash that was not built in, any slot or -1."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for k, bits in enumerate(self.levels):
            if not len(left):
                return out
            at = (_mix(hashes[left], 16 + k) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.ranks[k][at >> 6] + np.bitwise_count(below))[hit]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, hashes[left]), len(self.rest) - 1)
            hit = self.rest[at] == hashes[left]
            out[left[hit]] = self.base + at[hit]
        return out


class Bucket:
    """One bucket of the index."""

    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as z:
            self.hash = PerfectHash([z[f"level{k}"] for k in range(int(z["n_levels"]))], z["rest"])
            self.fingerprint, self.place = z["fingerprint"], z["place"]

    @staticmethod
    def pack(ids: np.ndarray, is_null: np.ndarray, occurrence: np.ndarray, place: np.ndarray) -> bytes:
        """place: shard, offset and count by key. Keys are distinct; if two have one hash, they can't be told apart."""
        h = key_hash(ids, is_null, occurrence)
        if len(np.unique(h)) < len(h):
            raise ValueError("two document keys have one 64-bit hash")
        perfect = PerfectHash.build(h)
        slot = perfect.slots(h)
        fingerprint, by_slot = np.zeros(len(h), np.uint32), np.zeros((len(h), 3), np.int64)
        fingerprint[slot], by_slot[slot] = _mix(h, 9) >> np.uint64(32), place
        out = io.BytesIO()
        np.savez(out, n_levels=len(perfect.levels), rest=perfect.rest, fingerprint=fingerprint, place=by_slot, **{f"level{k}": x for k, x in enumerate(perfect.levels)})
        return out.getvalue()

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, by its fingerprint, and its shard, offset and count."""
        slot = self.hash.slots(h)
        if not len(self.fingerprint):
            return np.zeros(len(h), bool), np.zeros((len(h), 3), np.int64)
        there = (slot >= 0) & (self.fingerprint[slot] == (_mix(h, 9) >> np.uint64(32)).astype(np.uint32))
        return there, self.place[slot]


class IdIndex:
    """Keyed access to a written folder: one bucket look-up and one read of the shard for each key."""

    def __init__(self, path: str):
        self.path, self.shape = path, json.loads(_get(f"{path}/shape.json"))
        self.buckets: dict[int, Bucket] = {}

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document, or None if there is no such key."""
        if not self.shape["buckets"]:
            return None
        h = key_hash(np.array([NULL_ID if doc_id is None else doc_id]), np.array([doc_id is None]), np.array([occurrence]))
        b = int(h[0] % np.uint64(self.shape["buckets"]))
        if b not in self.buckets:
            self.buckets[b] = Bucket(_get(f"{self.path}/index-{b:06d}.npz"))
        there, place = self.buckets[b].find(h)
        if not there[0]:
            return None
        shard, offset, count = place[0].tolist()
        width = self.shape["width"]
        fs, at = _open(f"{self.path}/ids-{shard:06d}.bin")
        with fs.open_input_file(at) as f:
            return np.frombuffer(f.read_at(count * width, offset * width), f"<u{width}")


# --- Spark jobs ------------------------------------------------------------------------

KEYS = "id_ long, is_null_ boolean, occurrence_ long"


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """Rows with KEYS, with their index bucket and together by it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            bucket = (key_hash(*cols) % np.uint64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket)], names=[*b.schema.names, "bucket_"])

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", bucket_ long"
    return df.mapInArrow(add, schema)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text with a tokenizers file (given by its path), append ``end_id`` and write shards and index below ``path``.

    Returns a row for each shard: shard_, rows_, tokens_, start_ (tokens before it).
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a fixed file of about 2 MB

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = None, TaskContext.get().partitionId()
        fs = at = own = out = None
        offset, last, seen = 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = WordEncoder.of(sent.value)
                end = np.array([end_id], encoder.kind).tobytes()
                fs, at = _open(f"{path}/ids-{number:06d}.bin")
                own = f"{at}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(own)
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[list] = [[] for _ in range(6)]
            for start in range(0, len(ids), 256):
                for doc_id, data in zip(ids[start : start + 256], encoder.encode([x or "" for x in texts[start : start + 256]]), strict=True):
                    out.write(data + end)
                    n = len(data) // encoder.kind.itemsize + 1
                    seen = seen + 1 if last == (doc_id,) else 0
                    last = (doc_id,)
                    for r, x in zip(rows, (NULL_ID if doc_id is None else doc_id, doc_id is None, seen, number, offset, n), strict=True):
                        r.append(x)
                    offset += n
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.bool_(), *[pa.int64()] * 4), strict=True)], names=["id_", "is_null_", "occurrence_", "shard_", "offset_", "count_"])
        if out is not None:
            out.close()
            fs.move(own, at)

    fs, at = _open(path)
    fs.create_dir(at, recursive=True)
    ordered = docs.select(F.col(id_col).cast("long").alias("id_"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"))
    ordered = ordered.repartitionByRange("id_", F.xxhash64("text_")).sortWithinPartitions("id_", "text_")
    places = materialise(ordered.mapInArrow(shard, KEYS + ", shard_ long, offset_ long, count_ long"), "places")

    # one row for each shard comes to the driver: its size and the run of equal ids it begins and ends with
    run = F.struct("is_null_", "id_")
    ends = places.groupBy("shard_").agg(F.count("*").alias("rows_"), F.sum("count_").alias("tokens_"), F.min_by(run, "offset_").alias("first"), F.max_by(run, "offset_").alias("last"), F.max_by("occurrence_", "offset_").alias("n"))
    shards, start, before = [], 0, {}
    for r in ends.orderBy("shard_").collect():
        carried = before.get(tuple(r["first"]), 0)
        shards.append((r["shard_"], r["rows_"], r["tokens_"], start, *r["first"], carried))
        start += r["tokens_"]
        before = {tuple(r["last"]): r["n"] + 1 + (carried if r["first"] == r["last"] else 0)}
    rows = sum(s[1] for s in shards)
    buckets = -(-rows // BUCKET_KEYS)
    starts = spark.createDataFrame(shards, "shard_ long, rows_ long, tokens_ long, start_ long, first_null boolean, first_id long, carried long")
    width = WordEncoder.of(sent.value).kind.itemsize
    if buckets:
        same = (F.col("id_") == F.col("first_id")) & (F.col("is_null_") == F.col("first_null"))
        keys = places.join(F.broadcast(starts), "shard_").select("id_", "is_null_", (F.col("occurrence_") + F.when(same, F.col("carried")).otherwise(0)).alias("occurrence_"), "shard_", "offset_", "count_")

        def build(key, group):
            c = {n: group.column(n).to_numpy() for n in group.schema.names}
            place = np.stack([c["shard_"], c["offset_"], c["count_"]], axis=1)
            _put(f"{path}/index-{key[0].as_py():06d}.npz", Bucket.pack(c["id_"], c["is_null_"], c["occurrence_"], place))
            return pa.table({"keys": pa.array([group.num_rows], pa.int64())})

        built = _bucketed(keys, buckets).groupBy("bucket_").applyInArrow(build, "keys long").agg(F.sum("keys")).first()[0]
        if built != rows:
            raise RuntimeError(f"{built} of {rows} documents were indexed")
    _put(f"{path}/shape.json", json.dumps({"width": width, "end_id": end_id, "rows": rows, "buckets": buckets}).encode())
    return starts.select("shard_", "rows_", "tokens_", "start_")


def read_ids(keys: DataFrame, path: str, starts: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Look up every row's document in a written folder and read its ids.

    Rows of ``keys`` with equal ids take its occurrences in turn. Returns the id, start,
    n_tokens, ids_crc32 and, with ``with_ids``, ids; a key that isn't there gives no row.
    """
    spark = keys.sparkSession
    shape = json.loads(_get(f"{path}/shape.json"))
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not shape["buckets"]:
        return spark.createDataFrame([], schema)
    width = shape["width"]
    each = keys.select(F.col(id_col).cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    each = each.select(F.coalesce("id", F.lit(NULL_ID)).alias("id_"), F.col("id").isNull().alias("is_null_"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("occurrence_"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = bucket = None
        for b in batches:
            ids, is_null, occurrence, of = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            h = key_hash(ids, is_null, occurrence)
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(of)], strict=True):
                if bucket != of[lo]:
                    bucket, loaded = of[lo], Bucket(_get(f"{path}/index-{of[lo]:06d}.npz"))
                there, place = loaded.find(h[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[lo:hi][there], is_null[lo:hi][there], *(place[there, k] for k in range(3)))], names=["id_", "is_null_", "shard_", "offset_", "count_"])

    found = _bucketed(each, shape["buckets"]).repartition("bucket_").sortWithinPartitions("bucket_")
    found = found.mapInArrow(find, "id_ long, is_null_ boolean, shard_ long, offset_ long, count_ long").join(F.broadcast(starts.select("shard_", "start_")), "shard_")
    # neighbours in a shard go to one task: its reads then follow one another
    near = found.repartition("shard_", F.floor(F.col("offset_") / (1 << 22))).sortWithinPartitions("shard_", "offset_")
    near = near.select("id_", "is_null_", "shard_", "offset_", "count_", "start_")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = f = None
        for b in batches:
            out: list[list] = [[] for _ in range(4 + with_ids)]
            for doc_id, is_null, shard, offset, count, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != shard:
                    if f is not None:
                        f.close()
                    fs, at = _open(f"{path}/ids-{shard:06d}.bin")
                    now, f = shard, fs.open_input_file(at)
                data = np.frombuffer(f.read_at(count * width, offset * width), f"<u{width}").astype("<u4")
                for c, x in zip(out, (None if is_null else doc_id, start + offset, len(data), zlib.crc32(data.tobytes())), strict=False):
                    c.append(x)
                if with_ids:
                    out[4].append(data.astype(np.int32))
            kinds = [*[pa.int64()] * 4, *[pa.list_(pa.int32())] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
        if f is not None:
            f.close()

    return near.mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> DataFrame:
    """Write all documents below ``path`` and read them back through the index."""
    starts = write_ids(docs, tokenizer, path, end_id)
    return read_ids(docs, path, starts)
