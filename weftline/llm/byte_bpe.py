"""Byte-level BPE encoding and decoding over padded numpy matrices.

Texts are split by the tokenizer's pattern. Pieces not met before are grouped by
length into padded matrices of byte ids; in each round every row merges its
leftmost pair of minimum rank, found by a hashed pair table, and is compacted.

Defined cases: a null text counts as empty; an empty text has no ids; rows with
equal or null ids are kept as they are; columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches

#: Cells of one padded matrix, and pieces remembered by one task before it starts afresh.
MATRIX_CELLS = 1 << 20
REMEMBERED = 400_000
#: A longer piece merges all occurrences of its minimum pair in a round where that gives the same ids.
LONG_PIECE = 256
NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        self.width = max(ranks.values()) + 1
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        key, value = np.array(keys, np.int64), np.array(values, np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]
            placed = self.keys[slot] == key
            self.values[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where there is none or a side is padding (negative)."""
        key = np.where((left < 0) | (right < 0), np.int64(-2), left * self.width + right)
        out = np.full(key.shape, NONE, np.int64)
        slot = self._slot(key)
        found = self.keys[slot]
        hit = found == key
        out[hit] = self.values[slot[hit]]
        left_over = np.nonzero(~hit & (found != -1) & (key >= 0))
        key, slot = key[left_over], slot[left_over]
        while len(key):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == key
            out[tuple(x[hit] for x in left_over)] = self.values[slot[hit]]
            more = ~hit & (found != -1)
            key, slot, left_over = key[more], slot[more], tuple(x[more] for x in left_over)
        return out


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.token = [b""] * self.pairs.width
        for token, rank in ranks.items():
            self.token[rank] = token
        # the reference library's white space is the Unicode property, not Python's
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.known: dict[str, bytes] = {}

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Merge each row of a matrix padded with -1 until no pair of it has a rank."""
        out = np.full(ids.shape, -1, np.int64)
        rows = np.arange(len(ids))
        rank = self.pairs.look_up(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 0), NONE)
        while len(rows):
            if rank.shape[1]:
                at = rank.argmin(1)
                best = rank[np.arange(len(rows)), at]
            else:
                best = np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                live = ~done
                rows, ids, rank = rows[live], ids[live], rank[live]
                if not len(rows):
                    break
                at, best = at[live], best[live]
            each = np.arange(len(rows))
            place = np.arange(ids.shape[1] - 1)
            keep = place + (place > at[:, None])  # drop the cell after the merged one
            ids[each, at] = best
            ids = np.take_along_axis(ids, keep, 1)
            if ids.shape[1] == 1:
                rank = np.full((len(rows), 0), NONE)
                continue
            # ranks move with the cells; only those beside the merged cell are looked up
            rank = np.take_along_axis(rank, np.minimum(place[:-1] + (place[:-1] > at[:, None]), rank.shape[1] - 1), 1)
            last = ids.shape[1] - 1
            before, after = np.maximum(at - 1, 0), np.minimum(at, last - 1)
            rank[each, before] = self.pairs.look_up(ids[each, before], ids[each, before + 1])
            rank[each, after] = self.pairs.look_up(ids[each, after], ids[each, after + 1])
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece: all separate occurrences of the minimum pair at once, unless that makes a pair of lower or equal rank."""
        while len(ids) > 1:
            rank = self.pairs.look_up(ids[:-1], ids[1:])
            best = rank.min()
            if best == NONE:
                break
            at = np.nonzero(rank == best)[0]
            run = np.concatenate([[True], np.diff(at) > 1])  # of touching occurrences every second one, from the left
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            merged = self._replace(ids, at, best)
            new = at - np.arange(len(at))
            beside = np.concatenate([new[new > 0] - 1, new[new < len(merged) - 1]])
            if len(beside) and self.pairs.look_up(merged[beside], merged[beside + 1]).min() <= best:
                merged = self._replace(ids, at[:1], best)
            ids = merged
        return ids

    @staticmethod
    def _replace(ids: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
        ids = ids.copy()
        ids[at] = by
        return np.delete(ids, at + 1)

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not met before, in matrices of similar lengths."""
        coded = sorted(((len(b := p.encode("utf-8")), p, b) for p in pieces), key=lambda x: x[0])
        start = 0
        while start < len(coded):
            wide = coded[start][0]
            if wide > LONG_PIECE:
                _, piece, data = coded[start]
                self.known[piece] = self._merge_long(self.single[np.frombuffer(data, np.uint8)]).astype("<u4").tobytes()
                start += 1
                continue
            # a bucket's rows may be a quarter longer than its shortest
            limit, stop = wide + wide // 4, start
            while stop < len(coded) and coded[stop][0] <= limit and (stop - start) * limit < MATRIX_CELLS:
                stop += 1
            stop = max(stop, start + 1)
            lengths = np.array([c[0] for c in coded[start:stop]])
            full = int(lengths[-1])
            cells = np.arange(full) < lengths[:, None]
            ids = np.full((stop - start, full), -1, np.int64)
            ids[cells] = self.single[np.frombuffer(b"".join(c[2] for c in coded[start:stop]), np.uint8)]
            merged = self._merge_rows(ids)
            counts = (merged >= 0).sum(1)
            flat, ends = merged[merged >= 0].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts)]) * 4
            for k, (_, piece, _) in enumerate(coded[start:stop]):
                self.known[piece] = flat[ends[k] : ends[k + 1]]
            start = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*split) - self.known.keys() if split else set()
        if new:
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode each text and decode the ids again.

    Returns the id, ``ids`` (array of int; with ``keep_ids``), n_tokens, ids_sha256, decoded_sha256 and
    n_bytes of the decoded text. The rank file (a fixed vocabulary, under 2 MB) is read
    on the driver and sent with the tasks.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        bpe = ByteBpe(ranks.value, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            out: list[list] = [[], [], [], [], []]
            for start in range(0, len(texts), 512):
                for ids in bpe.encode(texts[start : start + 512]):
                    data = bpe.decode(ids)
                    for k, x in enumerate((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest(), len(data))):
                        out[k].append(x)
                    if keep_ids:
                        out[4].append(np.frombuffer(ids, "<i4"))
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]
            if keep_ids:
                columns, names = [*columns, pa.array(out[4], pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<int>" * keep_ids
    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_")), make, schema)
