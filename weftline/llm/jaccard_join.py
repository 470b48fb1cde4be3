"""Exact n-gram Jaccard join of documents by prefix filtering and prefix trees.

1. Every text becomes the set of its distinct word shingles (64-bit hashes). Equal sets are
   one class, so copies are not compared. Each class has a parity sketch of a bit a shingle or more.
2. One order of all shingles holds everywhere: those marked frequent come last, otherwise by
   hash. Two sets that are similar enough share a shingle among their first ``n - ceil(T n) + 1``.
   The mark is a fixed-size bitmap of the shingles seen often by tasks; any bitmap gives the
   same result, a good one keeps common passages out of the prefixes.
3. Classes that meet at a prefix shingle are candidates if lengths, positions and sketches allow
   the similarity; each of these bounds is exact. A shingle with many classes ties them together
   without a pair for each two; marked shingles are dealt by bands of length as well, in which
   all sets that are similar enough lie side by side.
4. Tied classes form groups. Sets to be compared are stored in a prefix tree, common shingles
   first, and others are run down it: overlaps are counted along shared paths, subtrees are left
   when the remaining lengths can't reach the overlap needed, or when all their sets are in the
   component already. A group of more than BLOCK sets is first compared, block by block, with a
   few leaders, again with leaders from outside the largest component so far, and so on; what is
   then still outside is compared with all sets of neighbouring length bands, as pairs of blocks.
5. Links join classes to components; a component is named by its least document id.

Defined cases: texts without words have an empty set and no links; with fewer words than a
shingle, the whole sequence is the one element; null ids take part but name no component
unless all its ids are null; repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, materialise
from weftline.llm.components import components

SKETCH_BITS = 1024  # at least
MARK_BITS = 1 << 25
#: Marked shingles at most; the threshold rises until they fit.
MARKED = 1 << 21
#: Up to so many classes at one shingle are compared two by two.
PAIRWISE = 48
#: Sets of one block of a large group, and their shingles, about.
BLOCK, BLOCK_SHINGLES = 200, 1_000_000
#: Leaders of a large group in one round, and rounds.
LEADERS, LEAD_ROUNDS = 6, 4
#: Rounds that add newly found frequent shingles to the marks.
ROUNDS = 3

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; A-Z count as a-z, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    acc = np.full(len(h) - width + 1, np.uint64(width * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for k in range(width):
        acc = _mix(acc + h[k : len(h) - width + 1 + k])
    return np.unique(acc)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit hash of the set."""
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
    return int(d[0]), int(d[1])


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles by hash modulo a power of two of at least their number: at most their difference can differ."""
    bits = max(SKETCH_BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount(((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of two sets' difference: the longer sketch is folded, as a modulus divides its multiples."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    m = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def marked(tokens: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = tokens & np.uint64(MARK_BITS - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def mark(bitmap: np.ndarray, tokens: np.ndarray) -> None:
    at = tokens.astype(np.uint64) & np.uint64(MARK_BITS - 1)
    np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def length_band(n: np.ndarray, percent: int) -> np.ndarray:
    """Bands a little wider than the ratio of lengths of similar sets, which therefore lie in the same or neighbouring bands."""
    return np.floor(np.log(n) / (1.001 * np.log(100 / percent))).astype(np.int64) if percent < 100 else np.asarray(n, np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# --- prefix tree -----------------------------------------------------------------------


class Trie:
    """A path-compressed prefix tree of ordered sets, kept in arrays by level."""

    def __init__(self, sets: list[np.ndarray]):
        """sets: sorted arrays of ranks, all different, not empty. Leaves are numbered in tree order."""
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        rows = [sets[k] for k in self.order]
        shared = [0]
        for a, b in zip(rows, rows[1:], strict=False):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared.append(int(differ[0]) if len(differ) else m)
        # each node: leaves [lo, hi), tokens of its edge (from, to) in row lo, and the leaf that ends there
        lengths = np.array([len(r) for r in rows])
        nodes: list[list[tuple]] = []
        level = [(0, len(rows), 0)]
        shared_arr = np.array(shared)
        while level:
            here, below = [], []
            for lo, hi, depth in level:
                cuts = [lo]
                if hi - lo > 1:
                    inner = np.flatnonzero(shared_arr[lo + 1 : hi] <= depth) + lo + 1
                    cuts += inner.tolist()
                for a, b in zip(cuts, [*cuts[1:], hi], strict=True):
                    if lengths[a] == depth:  # this set ended at the parent
                        a += 1
                        if a >= b:
                            continue
                    to = int(lengths[a]) if b - a == 1 else int(min(shared_arr[a + 1 : b].min(), lengths[a]))
                    ends = a if lengths[a] == to else -1
                    here.append((a, b, depth, to, ends, len(below)))
                    if b - a > 1:
                        below.append((a, b, to))
            nodes.append(here)
            level = below
        self.levels, self.lengths = [], lengths
        for k, here in enumerate(nodes):
            if not here:
                break
            lo, hi, start, to, ends, _ = (np.array(c) for c in zip(*here, strict=True))
            tokens = np.concatenate([rows[a][s:t] for a, s, t in zip(lo.tolist(), start.tolist(), to.tolist(), strict=True)])
            size = to - start
            first = np.concatenate([[0], np.cumsum(size)])
            least = np.array([lengths[a:b].min() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            most = np.array([lengths[a:b].max() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            last = np.array([rows[a][t - 1] for a, t in zip(lo.tolist(), to.tolist(), strict=True)])
            self.levels.append({"lo": lo, "hi": hi, "to": to, "ends": ends, "tokens": tokens, "first": first, "least": least, "most": most, "last": last, "parent": np.zeros(len(lo), np.int64)})
            if k:
                up = self.levels[k - 1]
                self.levels[k]["parent"] = np.searchsorted(up["lo"], lo, side="right") - 1

    def search(self, query: np.ndarray, mask: np.ndarray, wanted: np.ndarray, percent: int) -> list[int]:
        """Leaves similar to a set of ranks; ``mask`` has its ranks set, ``wanted`` (by leaf) says which are of interest."""
        n, found = len(query), []
        upto = np.concatenate([[0], np.cumsum(wanted)])
        overlap = alive = None
        for level in self.levels:
            if alive is None:
                live = np.arange(len(level["lo"]))
                before = np.zeros(len(live), np.int64)
            else:
                live = np.flatnonzero(alive[level["parent"]])
                before = overlap[level["parent"][live]]
            least, most = level["least"][live], level["most"][live]
            keep = (upto[level["hi"][live]] > upto[level["lo"][live]]) & (100 * most >= percent * n) & (100 * n >= percent * least)
            live, before, least, most = live[keep], before[keep], least[keep], most[keep]
            if not len(live):
                break
            first, size = level["first"][live], level["first"][live + 1] - level["first"][live]
            at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            c = before + np.add.reduceat(mask[level["tokens"][at]], np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64)
            ends = level["ends"][live]
            done = (ends >= 0) & ((100 + percent) * c >= percent * (n + level["to"][live])) & wanted[ends]
            found += ends[done].tolist()
            rest = np.minimum(n - np.searchsorted(query, level["last"][live], side="right"), most - level["to"][live])
            reach = (100 + percent) * (c + rest) >= percent * (n + least)
            alive, overlap = np.zeros(len(level["lo"]), bool), np.zeros(len(level["lo"]), np.int64)
            alive[live[reach]], overlap[live] = True, c
        return found


def links_of(stored: list[np.ndarray], queries: list[np.ndarray] | None, percent: int, names: list | None = None) -> list[tuple[int, int]]:
    """Links (position in queries, position in stored) that join all similar sets; without ``queries``, among the stored ones.

    ``names`` holds the component that each stored set, then each query, is known to be in: sets of one need no link.
    """
    every = stored + (queries or [])
    values, inverse, counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))  # common shingles first: long shared paths
    flat, at, ranked = rank[inverse], 0, []
    for s in every:
        ranked.append(np.sort(flat[at : at + len(s)]))
        at += len(s)
    trie = Trie(ranked[: len(stored)])
    number: dict = {}
    known = np.array([number.setdefault(name, len(number)) for name in (names or range(len(every)))])
    by_leaf = known[trie.order]
    label = np.arange(len(number))  # component by number
    mask, out = np.zeros(len(values), bool), []
    first = 0 if queries is None else len(stored)
    for q, query in enumerate(ranked[first:]):
        own = known[first + q]
        wanted = label[by_leaf] != label[own]
        if not wanted.any():
            continue
        mask[query] = True
        for leaf in trie.search(query, mask, wanted, percent):
            if label[by_leaf[leaf]] != label[own]:
                out.append((q, trie.order[leaf]))
                label[label == label[by_leaf[leaf]]] = label[own]
        mask[query] = False
    return out


# --- Spark jobs ------------------------------------------------------------------------


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a task holds the sets of few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _pass_sets(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (end_ = 0) and for each shingle seen twice or more by a batch of different sets (end_ = 1)."""
    kind = docs.schema["id_"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 4096):
            rows: list[list] = [[] for _ in range(4)]
            seen, parts = set(), []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                a, b = set_key(s)
                for r, x in zip(rows, (len(s), a, b, sketch(s) if len(s) else None), strict=True):
                    r.append(x)
                if (a, b) not in seen:
                    seen.add((a, b))
                    parts.append(s)
            n = batch.num_rows
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            values, counts = values[counts > 1], counts[counts > 1]
            m = len(values)
            none = lambda t: pa.nulls(m, t)
            cols = [
                pa.concat_arrays([batch.column(0), none(batch.schema.field(0).type)]),
                pa.concat_arrays([pa.array(rows[0], pa.int64()), none(pa.int64())]),
                pa.concat_arrays([pa.array(rows[1], pa.int64()), pa.array(values.view(np.int64))]),
                pa.concat_arrays([pa.array(rows[2], pa.int64()), pa.array(counts.astype(np.int64))]),
                pa.concat_arrays([pa.array(rows[3], pa.binary()), none(pa.binary())]),
                pa.array([0] * n + [1] * m, pa.int32()),
                pa.concat_arrays([batch.column(2), none(pa.int64())]),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id_", "n_", "h1_", "h2_", "sketch_", "end_", "x_"])

    return map_arrow(docs.select("*", F.xxhash64("text_").alias("x_")), run, f"id_ {kind}, n_ long, h1_ long, h2_ long, sketch_ binary, end_ int, x_ long")


def _prefixes(docs: DataFrame, size: int, percent: int, bitmap) -> DataFrame:
    """Prefix shingles of every set: token, h1, n, pos, late.

    A marked one is dealt by length band as well: to the set's own and the next, under a hash of token and band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = np.frombuffer(bitmap.value, np.uint8), set()
        for batch in _slices(batches, 1024):
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                key = set_key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                late = marked(s, marks)
                p = prefix_length(len(s), percent)
                rare = min(p, int((~late).sum()))
                token, pos = s[~late][:rare], np.arange(rare, dtype=np.int32)
                if rare < p:
                    common, band = s[late][: p - rare], length_band(np.array([len(s)]), percent).astype(np.uint64)
                    token = np.concatenate([token, _mix(common + band * _M1), _mix(common + (band + np.uint64(1)) * _M1)])
                    pos = np.concatenate([pos, *[np.arange(rare, p, dtype=np.int32)] * 2])
                k = len(token)
                for o, x in zip(out, (token.view(np.int64), np.full(k, key[0]), np.full(k, len(s), np.int32), pos, np.arange(k) >= rare), strict=True):
                    o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["token", "h1", "n", "pos", "late"])

    return map_arrow(docs, run, "token long, h1 long, n int, pos int, late boolean")


def _meetings(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of classes (tie = 0), ties of large groups (tie = 1), and frequent shingles without a mark (tie = 2, in a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out: list[np.ndarray] = []
        kept: tuple | None = None  # rows of the last shingle, which may go on
        large: tuple | None = None  # shingle, leader and last length of a large group that may go on

        def close(token, h1, n, pos):
            """Pairs of classes at one shingle, for all shingles at hand, within the bounds of lengths and positions."""
            for step in range(1, PAIRWISE):
                i = np.flatnonzero(token[:-step] == token[step:])
                if not len(i):
                    break
                j = i + step
                # at the first shingle that two sets share, only what follows in both can be shared still
                ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((100 + percent) * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= percent * (n[i] + n[j]))
                i, j = i[ok], j[ok]
                if len(i):
                    a_out.append(np.stack([np.minimum(h1[i], h1[j]), np.maximum(h1[i], h1[j]), np.zeros(len(i), np.int64)]))

        def tie(token, h1, n, leader, last):
            """Tie classes in order of length to a leader, anew after a gap that no similar sets can bridge."""
            prev = np.concatenate([[n[0] if last is None else last], n[:-1]])
            gap = 100 * prev < percent * n
            heads = np.where(gap, np.arange(len(n)), -1)
            heads = np.maximum.accumulate(heads)
            lead = np.where(heads >= 0, h1[heads], h1[0] if leader is None else leader)
            own = lead != h1
            a_out.append(np.stack([np.minimum(lead, h1)[own], np.maximum(lead, h1)[own], np.ones(own.sum(), np.int64)]))
            return token, int(lead[-1]), int(n[-1])

        def begin_large(token, h1, n, late):
            if not late:
                a_out.append(np.array([[token], [token], [2]]))
            return tie(token, h1, n, None, None)

        def flush():
            nonlocal a_out
            if a_out:
                x = np.concatenate(a_out, axis=1)
                a_out = []
                if x.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["a", "b", "tie"])

        before: tuple | None = None  # the row before, to drop what copies in other tasks have repeated
        for batch in batches:
            token, h1, n, pos = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
            late = batch.column(4).to_numpy(zero_copy_only=False)
            if not len(token):
                continue
            new = np.concatenate([[before != (token[0], h1[0])], (token[1:] != token[:-1]) | (h1[1:] != h1[:-1])])
            before = (token[-1], h1[-1])
            token, h1, n, pos, late = token[new], h1[new], n[new], pos[new], late[new]
            if large is not None:
                same = int((token == large[0]).sum())
                if same:
                    large = tie(large[0], h1[:same], n[:same], large[1], large[2])
                    token, h1, n, pos, late = token[same:], h1[same:], n[same:], pos[same:], late[same:]
                if not len(token):
                    yield from flush()
                    continue
                large = None
            if kept is not None:
                token, h1, n, pos, late = (np.concatenate(p) for p in zip(kept, (token, h1, n, pos, late), strict=True))
                kept = None
            if not len(token):
                continue
            cut = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.concatenate([cut, [len(token)]]))
            whole, last = size[:-1], int(cut[-1])  # the last shingle may go on
            for lo, m in zip(cut[:-1][whole > PAIRWISE].tolist(), whole[whole > PAIRWISE].tolist(), strict=True):
                begin_large(int(token[lo]), h1[lo : lo + m], n[lo : lo + m], late[lo])
            few = np.repeat((whole > 1) & (whole <= PAIRWISE), whole)
            close(token[:last][few], h1[:last][few], n[:last][few], pos[:last][few])
            if size[-1] > PAIRWISE:
                large = begin_large(int(token[last]), h1[last:], n[last:], late[last])
            else:
                kept = (token[last:], h1[last:], n[last:], pos[last:], late[last:])
            yield from flush()
        if kept is not None:
            close(*kept[:4])
        yield from flush()

    dealt = rows.repartition("token").sortWithinPartitions("token", "n", "h1")
    return map_arrow(dealt, run, "a long, b long, tie long")


def _near(percent: int):
    """Keeps the pairs whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            least = np.array([apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            ok = pa.array(least * (100 + percent) <= n * (100 - percent))
            yield batch.select(["a", "b"]).filter(ok)

    return run


def _member_sets(docs: DataFrame, size: int, members) -> DataFrame:
    """Sets of the classes whose hash is in a bitmap: h1, h2, n, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(members.value, np.uint8), set()
        for batch in _slices(batches, 1024):
            rows: list[list] = [[] for _ in range(4)]
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                if not len(s):
                    continue
                key = set_key(s)
                if key in seen or not marked(np.array([key[0]]).view(np.uint64), bits)[0]:
                    continue
                seen.add(key)
                for r, x in zip(rows, (*key, len(s), s.tobytes()), strict=True):
                    r.append(x)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.binary())], ["h1", "h2", "n", "tokens"])

    return map_arrow(docs, run, "h1 long, h2 long, n long, tokens binary")


def _bitmap_of(df: DataFrame, column: str) -> np.ndarray:
    """Fixed-size bitmap of a column of hashes, made by tasks and joined as eight slices each of bounded size."""
    slice_bytes = MARK_BITS // 8 // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARK_BITS // 8, np.uint8)
        for batch in batches:
            mark(bits, batch.column(0).to_numpy())
        for k in range(64):
            own = bits[k * slice_bytes : (k + 1) * slice_bytes]
            if own.any():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(at + k * slice_bytes), pa.array(own[at].astype(np.int64))], ["at", "bits"])

    found = map_arrow(df.select(column), run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(MARK_BITS // 8, np.uint8)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return out


def _compared(dealt: DataFrame, percent: int) -> DataFrame:
    """Links of each deal: columns a and b, the two classes as text. dealt: deal, side, known, h1, h2, tokens.

    Sets of side 1 are run down the tree of those of side 0, or the latter among themselves where
    there is no side 1; sets of one component (``known``) are not linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        key = None

        def done() -> pa.RecordBatch | None:
            stored = [r for r in kept if r[0] == 0]
            queries = [r for r in kept if r[0] == 1]
            if not stored or len(kept) < 2 or len({r[1] for r in kept}) < 2:
                return None
            of = lambda rows: [np.frombuffer(r[4], np.uint64) for r in rows]
            links = links_of(of(stored), of(queries) if queries else None, percent, [r[1] for r in stored + queries])
            left = queries or stored
            name = lambda r: f"{r[2]}:{r[3]}"
            return pa.RecordBatch.from_arrays([pa.array([name(left[q]) for q, _ in links], pa.string()), pa.array([name(stored[s]) for _, s in links], pa.string())], ["a", "b"]) if links else None

        for batch in batches:
            deal, side, known, h1, h2 = (batch.column(k).to_pylist() for k in range(5))
            tokens = batch.column(5)
            for r in range(batch.num_rows):
                if key != deal[r]:
                    if key is not None and (x := done()) is not None:
                        yield x
                    key, kept = deal[r], []
                kept.append((side[r], known[r], h1[r], h2[r], tokens[r].as_buffer().to_pybytes()))
        if key is not None and (x := done()) is not None:
            yield x

    dealt = dealt.select("deal", "side", "known", "h1", "h2", "tokens")
    return map_arrow(dealt.repartition("deal").sortWithinPartitions("deal"), run, "a string, b string")


def _named(h1: str = "h1", h2: str = "h2"):
    return F.concat_ws(":", F.col(h1).cast("string"), F.col(h2).cast("string"))


def _blocks(members, shingles):
    return F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("long")


def _upto(n):
    return F.sequence(F.lit(0).cast("long"), n - 1)


def _merged(open_: DataFrame, met: DataFrame) -> DataFrame:
    """Members (group, name, known, main) after links a, b whose b is a leader; groups that are one component go.

    A group has LEADERS leaders at most, so a component touches few of them and a group has at
    most 2 ** LEADERS different sets of leaders that are touched: these are merged without star steps.
    """
    known = lambda end: open_.select("group", F.col("name").alias(end), F.col("known").alias(f"known_{end}"))
    edges = met.join(known("a"), "a").join(known("b").drop("group"), "b").select("group", "known_a", "known_b")
    ends = F.array(F.struct(F.col("known_a").alias("known"), F.col("known_b").alias("leader")), F.struct(F.col("known_b").alias("known"), F.col("known_b").alias("leader")))
    touched = edges.select("group", F.explode(ends).alias("e")).groupBy("group", "e.known").agg(F.sort_array(F.collect_set("e.leader")).alias("leaders"))
    touched = materialise(touched, "touched")

    def merge(done, one):
        """Disjoint sets and one more: those that overlap with it become one."""
        of = F.filter(done, lambda x: F.arrays_overlap(x, one))
        return F.concat(F.filter(done, lambda x: ~F.arrays_overlap(x, one)), F.array(F.array_distinct(F.flatten(F.concat(F.array(one), of)))))

    merged = touched.groupBy("group").agg(F.collect_set("leaders").alias("sets")).select("group", F.explode(F.aggregate("sets", F.array().cast("array<array<string>>"), merge)).alias("one"))
    roots = merged.select("group", F.explode("one").alias("leader"), F.array_min("one").alias("root_"))
    roots = touched.select("group", "known", F.col("leaders")[0].alias("leader")).join(roots, ["group", "leader"]).drop("leader")
    now = open_.drop("main").join(roots, ["group", "known"], "left").select("group", "name", F.coalesce("root_", "known").alias("known"))
    counted = now.groupBy("group", "known").agg(F.count("*").alias("n"))
    most = counted.groupBy("group").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.count("*").alias("parts"))
    return materialise(now.join(most, "group").where("parts > 1").select("group", "name", "known", (F.col("known") == F.col("main")).alias("main")), "known")


def _group_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links of each group: columns a and b, the two classes as text. sets: group, h1, h2, n, tokens (a written table)."""
    sizes = sets.groupBy("group").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    name, none = _named(), F.lit(0)
    in_one = sets.join(sizes.where("blocks = 1"), "group").select(F.col("group").cast("string").alias("deal"), none.alias("side"), name.alias("known"), "h1", "h2", "tokens")
    out = materialise(_compared(in_one, percent), "links")
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return out
    sets = materialise(sets.join(large, "group").withColumn("name", name), "large")
    open_ = sets.select("group", "name", F.col("name").alias("known"), F.lit(False).alias("main"))
    found = out.limit(0)
    for turn in range(LEAD_ROUNDS):
        # every block of a group that isn't one component yet meets the same few leaders
        chosen = open_.where("not main").groupBy("group").agg(F.array_distinct(F.array(*[F.min_by("name", F.xxhash64("name", F.lit(turn * LEADERS + k))) for k in range(LEADERS)])).alias("names"))
        leaders = sets.join(chosen.select("group", F.explode("names").alias("name")), ["group", "name"])
        own = sets.join(open_.select("name", "known"), "name")
        deal = lambda block: F.concat_ws(":", "group", block)
        stored = leaders.join(open_.select("name", "known"), "name").withColumn("block", F.explode(_upto(F.col("blocks")))).select(deal("block").alias("deal"), none.alias("side"), "known", "h1", "h2", "tokens")
        queries = own.select(deal(F.pmod(F.xxhash64("h2"), "blocks")).alias("deal"), F.lit(1).alias("side"), "known", "h1", "h2", "tokens")
        met = materialise(_compared(stored.unionByName(queries), percent), "links")
        found = found.unionByName(met)
        open_ = _merged(open_, met)
        if open_.isEmpty():
            return out.unionByName(found)

    # what no leader has joined to its group's largest component meets all sets of neighbouring bands
    rest = sets.drop("blocks").join(open_.select("name", "known", "main"), "name")
    width = 1.001 * float(np.log(100 / percent)) if percent < 100 else 1.0
    rest = rest.withColumn("band", F.floor((F.log("n") if percent < 100 else F.col("n")) / width).cast("long"))
    blocks = rest.groupBy("group", "band", "main").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    rest = rest.join(blocks, ["group", "band", "main"]).withColumn("block", F.concat_ws(":", "group", "band", "main", F.pmod(F.xxhash64("h2"), "blocks"))).drop("blocks")
    others = blocks.select("group", F.col("band").alias("other_band"), F.col("main").alias("other_main"), F.explode(_upto(F.col("blocks"))).alias("k"))
    others = others.select("group", "other_band", "other_main", F.concat_ws(":", "group", "other_band", "other_main", "k").alias("other"))
    pairs = rest.withColumn("other_band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))).join(others, ["group", "other_band"]).where("not (main and other_main)")
    dealt = pairs.select(F.concat_ws("|", F.least("block", "other"), F.greatest("block", "other")).alias("deal"), (F.col("block") > F.col("other")).cast("int").alias("side"), "known", "h1", "h2", "tokens")
    return out.unionByName(found).unionByName(materialise(_compared(dealt, percent), "links"))


def _row_components(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Every row's id_, x_ (hash of its text), n_, root_ (one class of its component; null without words) and component_."""
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    first = materialise(_pass_sets(source, size), "sets")
    rows = first.where("end_ = 0").select("id_", "x_", "n_", "h1_", "h2_")
    seen = first.where("end_ = 1").groupBy(F.col("h1_").alias("token")).agg(F.sum("h2_").alias("n"))
    seen = materialise(seen.where("n >= 8"), "seen")
    marks, threshold = np.zeros(MARK_BITS // 8, np.uint8), 8
    while seen.where(F.col("n") >= threshold).limit(MARKED + 1).count() > MARKED:
        threshold *= 2
    mark(marks, seen.where(F.col("n") >= threshold).select("token").toArrow().column(0).to_numpy())

    for turn in range(ROUNDS):
        sent = sc.broadcast(marks.tobytes())
        met = materialise(_meetings(_prefixes(source, size, percent, sent), percent), "met")
        new = met.where("tie = 2").select("a").distinct().limit(MARKED)
        if turn + 1 == ROUNDS or new.isEmpty():
            break
        mark(marks, new.toArrow().column(0).to_numpy())

    classes = first.where("end_ = 0 and n_ > 0").groupBy("h1_").agg(F.first("n_").alias("n"), F.first("sketch_").alias("sketch"))
    pairs = met.where("tie = 0").select("a", "b").distinct()
    side = lambda s: classes.select(F.col("h1_").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    near = map_arrow(pairs.select("a", "b", "na", "nb", "sa", "sb"), _near(percent), "a long, b long")
    groups = materialise(components(near.unionByName(met.where("tie = 1").select("a", "b"))).withColumnsRenamed({"node": "h1", "root": "group"}), "groups")
    members = sc.broadcast(_bitmap_of(groups, "h1").tobytes())
    sets = _member_sets(source, size, members).groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    links = _group_links(materialise(sets.join(groups, "h1"), "members"), percent)

    key = _named("h1_", "h2_")
    least = rows.where("n_ > 0").groupBy("h1_", "h2_").agg(F.min("id_").alias("least_")).withColumn("class_", key)
    roots = components(links)
    named = roots.join(least.select(F.col("class_").alias("node"), "least_"), "node")
    named = named.join(named.groupBy("root").agg(F.min("least_").alias("component_")), "root").select(F.col("node").alias("class_"), "root", "component_")
    named = least.join(named, "class_", "left").select("h1_", "h2_", F.coalesce("root", "class_").alias("root_"), F.coalesce("component_", "least_").alias("component_"))
    out = rows.where("n_ > 0").join(named, ["h1_", "h2_"]).select("id_", "x_", "n_", "root_", "component_")
    return out.unionByName(rows.where("n_ = 0").select("id_", "x_", "n_", F.lit(None).cast("string").alias("root_"), F.col("id_").alias("component_")))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, n_shingles and component_id under links of Jaccard similarity of at least ``percent`` hundredths."""
    out = _row_components(docs, size, percent, id_col, text_col)
    return out.select(F.col("id_").alias(id_col), F.col("n_").alias("n_shingles"), F.col("component_").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: that of the least id (nulls last), then hash of the text. Rows without words stay."""
    rows = materialise(_row_components(docs, size, percent, id_col, text_col), "components")
    grouped = rows.where("root_ is not null")
    best = grouped.groupBy("root_").agg(F.min(F.struct(F.col("id_").isNull().alias("null_"), "id_", "x_")).alias("best"))
    bare = rows.where("root_ is null").select("id_", "x_").distinct()
    kept = best.select("best.id_", "best.x_", F.lit(True).alias("single_")).unionByName(bare.withColumn("single_", F.lit(False)))
    # of repeated rows with one id and text the first of any order stays
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(F.col(text_col).cast("string")).alias("own_x"))
    found = texts.join(kept, F.col("own_id").eqNullSafe(F.col("id_")) & (F.col("own_x") == F.col("x_")))
    copies = grouped.groupBy("id_", "x_").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id_").alias("copy_id"), F.col("x_").alias("copy_x"), F.lit(True).alias("copied"))
    found = found.join(copies, F.col("own_id").eqNullSafe(F.col("copy_id")) & (F.col("own_x") == F.col("copy_x")), "left").select("row", "own_id", "own_x", (F.col("single_") & F.coalesce("copied", F.lit(False))).alias("copied"))
    once = found.where("copied").groupBy("own_id", "own_x").agg(F.first("row").alias("row")).select("row")
    return found.where("not copied").select("row").unionByName(once).select("row.*")
