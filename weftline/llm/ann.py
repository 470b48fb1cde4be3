"""Approximate nearest neighbours by inner product: NN-descent graph, greedy search.

Equal vectors are one node. The graph starts from blocks of vectors that lie together in the
order of random-hyperplane codes (several orders); inside a block every vector keeps its best
partners. NN-descent then joins neighbours of neighbours: along the kept edges every node
introduces its neighbours to each other, and each keeps the best it has met, until rounds
change hardly any list. A query starts from its own node, opens the best unopened nodes of its
pool, which holds the best that it has seen, and scores their neighbours, until its pool holds
no unopened node. Codes of every second order see directions only, those of the others see
vectors lengthened to a quantile of the norms, so neither long vectors nor the rest, beside a
few very long ones, share one code. Equal codes are dealt by a hash of node and order, so each
order cuts a group of them into other blocks.

Lists of the graph are bounded (BLOCK, NEIGHBOURS, REVERSE); a query's pool grows with the
square root of the nodes (``pool_size``), as the share of them that it has to see to find its
nearest does not fall as fast as they grow. Queries of like direction are searched in blocks
that share what any of them opens (SHARE); vectors and edges stay where their part of the nodes
is, and what travels is packed, a row for each block and part. The search is approximate; tests measure its
recall against brute force. Scores are exact.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows without id; rows equal in id and vector count
once; equal scores are ordered by id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.llm.common import discard, map_arrow, map_batches, materialise, release

BLOCK = 256
ORDERS = 8
NEIGHBOURS = 32
#: Edges of a node that take part in a round of NN-descent, each way.
FORWARD, REVERSE = 16, 16
#: Introductions that each node keeps of one meeting.
MET = 8
#: NN-descent ends with the round that changes less than this share of the list entries.
CHANGED = 0.02
#: A query's pool for up to POOL_NODES nodes, and nodes opened in a step.
POOL, POOL_NODES, OPEN = 128, 1 << 14, 48
#: Queries that share what they open.
SHARE = 64
#: Nodes of a part, whose vectors or edges one task holds, and the parts of tables that would have fewer.
PART, PARTS = 1 << 15, 32
CODE_BITS = 24
GRAPH = "node long, nbrs array<long>, scores array<float>"


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best different ids, without ``own``; of an id's scores, which may differ by a rounding, the highest counts."""
    down = np.argsort(-scores, kind="stable")
    ids, first = np.unique(ids[down], return_index=True)
    scores = scores[down][first]
    keep = ids != own
    ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _lists(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    nodes, ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    flat = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0), t))
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), flat(ids, pa.int64()), flat([s.astype(np.float32) for s in scores], pa.float32())], ["node", "nbrs", "scores"])


def _merged(lists: DataFrame) -> DataFrame:
    """One list of the best NEIGHBOURS for each node."""
    grouped = lists.groupBy("node").agg(F.flatten(F.collect_list("nbrs")).alias("nbrs"), F.flatten(F.collect_list("scores")).alias("scores"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes = batch.column(0).to_numpy().tolist()
            ids, scores = batch.column(1), batch.column(2)
            return _lists([(n, *_best(ids[k].values.to_numpy(), scores[k].values.to_numpy(), n, NEIGHBOURS)) for k, n in enumerate(nodes)])

        return step

    return map_batches(grouped, make, GRAPH)


def _coded(nodes: DataFrame, dim: int, kind: str, norms: list[float], orders: int) -> DataFrame:
    """Every node's vector once for each of the first ``orders`` orders, with its code; odd orders lengthen the vectors that are shorter than one of ``norms``."""

    def make():
        rng = np.random.default_rng(23)
        planes = rng.normal(size=(orders, dim + 1, CODE_BITS)).astype(np.float32)
        place = 1 << np.arange(CODE_BITS, dtype=np.int64)[::-1]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, vecs = batch.column(0).to_numpy(), batch.column(1)
            x = np.frombuffer(b"".join(v.as_buffer() for v in vecs), kind).reshape(-1, dim).astype(np.float32)
            square = (x * x).sum(1)
            sides = []
            for o, p in enumerate(planes):
                longest = norms[o // 2 % len(norms)] if o % 2 else 0.0
                sides.append((x @ p[:-1] + np.sqrt(np.maximum(longest**2 - square, 0))[:, None] * p[-1] > 0) @ place)
            codes = np.stack(sides, axis=1)
            order = np.tile(np.arange(orders), len(ids))
            each = np.repeat(np.arange(len(ids)), orders)
            return pa.RecordBatch.from_arrays([pa.array(order), pa.array(codes.ravel()), pa.array(ids[each]), vecs.take(pa.array(each))], ["order_", "code", "node", "vec"])

        return step

    return map_batches(nodes, make, "order_ long, code long, node long, vec binary")


def _start(nodes: DataFrame, n: int, dim: int, kind: str, norms: list[float]) -> DataFrame:
    """The first graph, from blocks of each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []  # what has come of a block: its order, names and vectors

        def block() -> Iterator[pa.RecordBatch]:
            names = np.concatenate([h[1] for h in held])
            x = np.concatenate([h[2] for h in held])
            held.clear()
            k = min(NEIGHBOURS, len(names) - 1)
            if k < 1:
                return
            for lo in range(0, len(names), 512):
                g = x[lo : lo + 512] @ x.T
                g[np.arange(len(g)), np.arange(lo, lo + len(g))] = -np.inf
                at = np.argpartition(-g, k - 1, axis=1)[:, :k]
                s = np.take_along_axis(g, at, 1)
                offsets = pa.array(np.arange(0, len(g) * k + 1, k, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 512]), pa.ListArray.from_arrays(offsets, pa.array(names[at.ravel()])), pa.ListArray.from_arrays(offsets, pa.array(s.ravel(), pa.float32()))], ["node", "nbrs", "scores"])

        for batch in batches:
            orders, names = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = np.frombuffer(b"".join(v.as_buffer() for v in batch.column(3)), kind).reshape(-1, dim).astype(np.float32)
            at = 0
            while at < len(names):
                if held and (held[0][0] != orders[at] or sum(len(h[1]) for h in held) >= BLOCK):
                    yield from block()
                stop = min(at + BLOCK - sum(len(h[1]) for h in held), int(np.searchsorted(orders, orders[at], "right")))
                held.append((orders[at], names[at:stop], x[at:stop]))
                at = stop
        if held:
            yield from block()

    # each partition holds many blocks, so that its last, shorter one matters little
    parts = max(1, n * ORDERS // (16 * BLOCK))
    salt = F.xxhash64("node", "order_").alias("salt")
    coded = _coded(nodes, dim, kind, norms, ORDERS).select("order_", "code", "node", "vec", salt)
    coded = coded.repartitionByRange(parts, "order_", "code", "salt").sortWithinPartitions("order_", "code", "salt")
    return _merged(map_arrow(coded, run, GRAPH))


def _edges(graph: DataFrame, forward: int, reverse: int) -> DataFrame:
    """The ``forward`` best edges of each node, and the ``reverse`` best that lead to it, turned round: node, nbr."""
    out = graph.select("node", F.posexplode(F.arrays_zip("nbrs", "scores")).alias("k", "e")).where(F.col("k") < forward).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.scores").alias("score"))
    by = W.Window.partitionBy("nbr").orderBy(F.desc("score"), "node")
    kept = out.withColumn("r", F.row_number().over(by)).where(F.col("r") <= reverse)
    return out.select("node", "nbr").unionByName(kept.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()


def _descend(graph: DataFrame, nodes: DataFrame, dim: int, kind: str) -> DataFrame:
    """One round: join each node's neighbours with their vectors, let them meet, and merge what they found.

    A node brings the least score of its list along, if that is full, and is told only of what can enter it.
    """
    least = graph.select("node", F.when(F.size("scores") >= NEIGHBOURS, F.element_at("scores", -1)).alias("least"))
    known = nodes.join(least, "node", "left").select(F.col("node").alias("nbr"), "vec", F.coalesce("least", F.lit(float("-inf")).cast("float")).alias("least"))
    meet = _edges(graph, FORWARD, REVERSE).join(known, "nbr")
    meet = meet.groupBy("node").agg(F.collect_list(F.struct("nbr", "vec", "least")).alias("members"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            nodes_, nbrs, scores, sizes = [], [], [], []
            for members in batch.column(1):
                ids = members.values.field("nbr").to_numpy()
                x = np.frombuffer(b"".join(v.as_buffer() for v in members.values.field("vec")), kind).reshape(-1, dim).astype(np.float32)
                if len(ids) < 2:
                    continue
                g = x @ x.T
                np.fill_diagonal(g, -np.inf)
                k = min(MET, len(ids) - 1)
                at = np.argpartition(-g, k - 1, axis=1)[:, :k]
                s = np.take_along_axis(g, at, 1)
                fits = s >= members.values.field("least").to_numpy()[:, None]
                many = fits.sum(1)
                nodes_.append(ids[many > 0])
                sizes.append(many[many > 0])
                nbrs.append(ids[at[fits]])
                scores.append(s[fits])
            if not nodes_:
                return None
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes_)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(nbrs))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(scores), pa.float32()))], ["node", "nbrs", "scores"])

        return step

    return _merged(graph.unionByName(map_batches(meet, make, GRAPH)))


def _changed(before: DataFrame, after: DataFrame) -> float:
    """The share of the list entries of ``after`` that ``before`` lacks."""
    both = after.join(before.select("node", F.col("nbrs").alias("old")), "node", "left")
    fresh = F.size(F.array_except("nbrs", F.coalesce("old", F.array().cast("array<long>"))))
    new, every = both.agg(F.sum(fresh), F.sum(F.size("nbrs"))).first()
    return new / every if every else 0.0


def pool_size(n: int) -> int:
    """Entries of a query's pool among ``n`` nodes."""
    return POOL * max(1, math.ceil(math.sqrt(n / POOL_NODES)))


#: Rows of the search: numbers and vectors of many nodes or queries packed in each cell.
PACKED = "tag int, part int, block long, a binary, b binary, c binary, d binary, e binary"


def part_count(n: int) -> int:
    """Parts that ``n`` nodes are dealt to by their hash."""
    return max(math.ceil(n / PART), min(PARTS, math.ceil(n / 256)))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (tag, part, block, cells) as a batch of PACKED; cells are arrays."""
    tags, parts, blocks, *cells = zip(*[(*r, *[None] * (8 - len(r))) for r in rows], strict=True)
    cells = [pa.array([None if x is None else x.tobytes() for x in c], pa.binary()) for c in cells]
    return pa.RecordBatch.from_arrays([pa.array(tags, pa.int32()), pa.array(parts, pa.int32()), pa.array(blocks, pa.int64()), *cells], ["tag", "part", "block", "a", "b", "c", "d", "e"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, Callable[[int, str], np.ndarray]]]:
    """Stretches of rows of one (part, block, tag): these, and a function that gives a cell's array, of all their rows."""
    for batch in batches:
        tags, parts, blocks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cuts = np.flatnonzero((np.diff(tags) != 0) | (np.diff(parts) != 0) | (np.diff(blocks) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tags)], strict=True):
            if hi > lo:
                cell = lambda k, t, part=batch.slice(lo, hi - lo): np.frombuffer(b"".join(v.as_buffer() for v in part.column(3 + k) if v.is_valid), t)
                yield int(parts[lo]), int(blocks[lo]), int(tags[lo]), cell


def _parted(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of a node's hash and what belongs to it as PACKED rows of tag 0 and block -1 by part: node, vec (a, b), or node, nbrs (a, c, with their numbers in b)."""
    dealt = rows.withColumn("part", F.pmod("node", F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part")
    lists = "nbrs" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                held = batch.column(1).slice(lo, hi - lo)
                if hi == lo:
                    continue
                names = batch.column(0).slice(lo, hi - lo).to_numpy()
                if lists:
                    yield _packed([(0, int(of[lo]), -1, names, held.value_lengths().to_numpy().astype(np.int32), held.flatten().to_numpy())])
                else:
                    yield _packed([(0, int(of[lo]), -1, names, np.frombuffer(b"".join(v.as_buffer() for v in held), np.uint8))])

    return map_arrow(dealt, run, PACKED)


def _dealt(queries: DataFrame, nodes: DataFrame, n: int, dim: int, kind: str, parts: int, size: int) -> DataFrame:
    """Queries in blocks of some SHARE of like direction, with empty pools: PACKED rows of ``_merge``."""
    # in the order of their codes, and of a hash where these are equal; cut at quantiles, whatever the partitions are
    key = (F.col("code") * F.lit(1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))).alias("key")
    coded = materialise(_coded(queries.join(nodes, "node"), dim, kind, [0.0], orders=1).select(key, "node", "vec"), "queries")
    blocks = max(1, math.ceil(n / SHARE))
    cuts = coded.agg(F.percentile_approx("key", [k / blocks for k in range(1, blocks)], 100_000)).first()[0] if blocks > 1 else None
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("key"))).cast("long") if cuts else F.lit(0).cast("long")
    dealt = coded.select(block.alias("block"), "node", "vec").repartition(min(blocks, parts), "block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def end() -> Iterator[pa.RecordBatch]:
            if held:
                own = np.concatenate([b.column(1).to_numpy() for b in held])
                vecs = np.frombuffer(b"".join(v.as_buffer() for b in held for v in b.column(2)), kind)
                held.clear()
                empty = np.zeros((len(own), size), np.int64), np.full((len(own), size), -np.inf), np.ones((len(own), size), bool)
                yield _packed([(0, 0, now, own, vecs, *empty), (3, 0, now, vecs, empty[1][:, -1]), *_by_part(1, now, own, parts)])

        for batch in batches:
            of = batch.column(0).to_numpy()
            at = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(at, at[1:], strict=False):
                if hi > lo:
                    if of[lo] != now:
                        yield from end()
                        now = int(of[lo])
                    held.append(batch.slice(lo, hi - lo))
        yield from end()

    return map_arrow(dealt, run, PACKED)


def _by_part(tag: int, block: int, ids: np.ndarray, parts: int) -> list[tuple]:
    """A row for each part that any of the nodes lie in."""
    of = np.mod(ids, parts)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [(tag, int(of[at[0]]), block, ids[at]) for at in np.split(order, cuts) if len(at)]


def _reached(asked: DataFrame, near: DataFrame, parts: int) -> DataFrame:
    """The nodes that blocks open (tag 1) and their neighbours, by the part that they lie in (tag 3); near: ``_parted`` lists."""
    rows = near.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunks, names = None, [], None
        now, ids = None, []

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal names, counts, starts, flat
            if not ids:
                return
            if names is None:
                names, counts, flat = (np.concatenate([c[k] for c in chunks]) if chunks else np.zeros(0, np.int64) for k in range(3))
                order = np.argsort(names)
                starts = (np.cumsum(counts) - counts)[order]
                names, counts = names[order], counts[order]
            own = np.unique(np.concatenate(ids))
            ids.clear()
            at = np.searchsorted(names, own)
            at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == own)] if len(names) else at[:0]
            many = counts[at].astype(np.int64)
            # one after another, the places of each node's list
            places = np.repeat(starts[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            yield _packed(_by_part(3, now, np.unique(np.concatenate([own, flat[places]])), parts))

        counts = starts = flat = np.zeros(0, np.int64)
        for p, block, tag, cell in _runs(batches):
            if (p, block) != (part, now):
                yield from end()
                if p != part:
                    part, chunks, names = p, [], None
                now = block
            if tag == 0:
                chunks.append((cell(0, np.int64), cell(1, np.int32), cell(2, np.int64)))
            else:
                ids.append(cell(0, np.int64))
        yield from end()

    return map_arrow(rows, run, PACKED)


def _scored(rows: DataFrame, parts: int, dim: int, kind: str, size: int) -> DataFrame:
    """What blocks have reached (tag 3) and not seen before (tag 2: a bit for each node of the part) scored against their queries (tag 1); tag 0 holds the vectors.

    Returns what is seen now (tag 0) and, for each query, what can enter its pool (tag 1). Of one part these are at
    most ``most``: parts are dealt by a hash of the vectors, so a pool's members lie in them evenly.
    """
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "block", "tag")
    most = max(64, 4 * size // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunks, names, vecs = None, [], None, None
        now, held = None, {}

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal names, vecs
            if 1 not in held:
                return
            if names is None:
                names = np.concatenate([c[0] for c in chunks]) if chunks else np.zeros(0, np.int64)
                order = np.argsort(names)
                names = names[order]
                vecs = np.concatenate([c[1] for c in chunks]).reshape(-1, dim)[order].astype(float) if chunks else np.zeros((0, dim))
            queries, least = held[1]
            seen = np.unpackbits(held[2], count=len(names)).astype(bool) if 2 in held else np.zeros(len(names), bool)
            if 3 in held:
                ids = np.unique(np.concatenate(held[3]))
                at = np.searchsorted(names, ids)
                fresh = at[~seen[at]]
                seen[fresh] = True
                if len(fresh):
                    g = vecs[fresh] @ queries.T
                    fits = g >= least
                    if len(fresh) > most and fits.sum(0).max() > most:
                        fits &= g >= np.partition(g, len(fresh) - most, axis=0)[len(fresh) - most]
                    which, query = np.nonzero(fits)
                    if len(which):
                        yield _packed([(1, part, now, names[fresh[which]], query.astype(np.int32), g[fits])])
            if 3 in held or 2 in held:
                yield _packed([(0, part, now, np.packbits(seen))])

        for p, block, tag, cell in _runs(batches):
            if (p, block) != (part, now):
                yield from end()
                held.clear()
                if p != part:
                    part, chunks, names, vecs = p, [], None, None
                now = block
            if tag == 0:
                chunks.append((cell(0, np.int64), cell(1, kind)))
            elif tag == 1:
                held[1] = (cell(0, kind).reshape(-1, dim).astype(float), cell(1, float))
            elif tag == 2:
                held[2] = cell(0, np.uint8)
            else:
                held.setdefault(3, []).append(cell(0, np.int64))
        yield from end()

    return map_arrow(rows, run, PACKED)


def _merge(rows: DataFrame, blocks: int, parts: int, dim: int, kind: str, size: int, k: int) -> DataFrame:
    """Pools (tag 0: nodes and vectors of the queries, ids, scores, opened) with what was found for them (tag 1).

    Returns the pools that hold unopened nodes (tag 0), of which the best are marked as opened and asked for (tag 1, by
    part), their queries with the least score that can enter (tag 3), and of the others the k best and their equals (tag 2).
    """
    rows = rows.repartition(blocks, "block").sortWithinPartitions("block", "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pool, found = None, None, []

        def end() -> Iterator[pa.RecordBatch]:
            if pool is None:
                return
            own, vecs, *tables = pool
            tables = [t.reshape(len(own), size) for t in tables]
            full = tables[1] > -np.inf
            query = np.concatenate([np.nonzero(full)[0], *[f[1] for f in found]])
            ids = np.concatenate([tables[0][full], *[f[0] for f in found]])
            scores = np.concatenate([tables[1][full], *[f[2] for f in found]])
            opened = np.concatenate([tables[2][full], np.zeros(len(ids) - full.sum(), bool)])
            order = np.lexsort((ids, -scores, query))
            query, ids, scores, opened = query[order], ids[order], scores[order], opened[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            kept = rank < size
            at = query[kept], rank[kept]
            tables = [np.zeros((len(own), size), np.int64), np.full((len(own), size), -np.inf), np.ones((len(own), size), bool)]
            for t, v in zip(tables, (ids, scores, opened), strict=True):
                t[at] = v[kept]
            ids, scores, opened = tables
            done = opened.all(1)
            out = []
            if done.any():
                near = (scores >= scores[:, min(k, size) - 1][:, None]) & (scores > -np.inf) & done[:, None]
                which = np.nonzero(near)[0]
                out.append((2, 0, now, own[which], ids[near], scores[near]))
            if not done.all():
                left = ~done
                vecs = vecs.reshape(len(own), dim)[left]
                own, ids, scores, opened = own[left], ids[left], scores[left], opened[left]
                asked = np.unique(ids[~opened & (np.cumsum(~opened, axis=1) <= OPEN)])
                # what one query opens is scored against all of its block
                opened = opened | np.isin(ids, asked)
                out += [(0, 0, now, own, vecs, ids, scores, opened), (3, 0, now, vecs, scores[:, -1]), *_by_part(1, now, asked, parts)]
            yield _packed(out)

        for _, block, tag, cell in _runs(batches):
            if block != now:
                yield from end()
                now, pool, found = block, None, []
            if tag == 0:
                pool = cell(0, np.int64), cell(1, kind), cell(2, np.int64), cell(3, float), cell(4, bool)
            else:
                found.append((cell(0, np.int64), cell(1, np.int32), cell(2, float)))
        yield from end()

    return map_arrow(rows, run, PACKED)


def _search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, n: int, n_nodes: int, dim: int, kind: str, size: int, k: int) -> DataFrame:
    """Greedy search for ``n`` nodes: node, nbr, score of the ``k`` nearest and their equals. Pools without an unopened node are set aside, so a step works on the others only.

    The queries of a block share what any of them opens. Vectors and edges stay with their part of the nodes: a block
    asks the parts for its nodes' neighbours, these are scored where their vectors lie, and the block merges what can
    enter its pools. All of this moves packed, a row for each block and part.
    """
    spark = queries.sparkSession
    parts, blocks = part_count(n_nodes), max(1, math.ceil(n / SHARE))
    folders = lambda df: {f.rsplit("/tag=", 1)[0] for f in df.inputFiles()}
    near = materialise(_parted(_edges(graph, NEIGHBOURS, NEIGHBOURS).groupBy("node").agg(F.collect_list("nbr").alias("nbrs")), parts), "near")
    vecs = materialise(_parted(nodes.select("node", "vec"), parts), "parts")
    state = materialise(_dealt(queries, nodes, n, dim, kind, parts, size), "pools", "tag")
    answers, seen = [], None
    while not state.where("tag = 0").isEmpty():
        reached = _reached(state.where("tag = 1"), near, parts)
        asking = state.where("tag = 3").withColumns({"tag": F.lit(1), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
        rows = vecs.unionByName(asking).unionByName(reached)
        if seen is not None:
            rows = rows.unionByName(seen.where("tag = 0").withColumn("tag", F.lit(2)))
        scored = materialise(_scored(rows, parts, dim, kind, size), "scored", "tag")
        after = materialise(_merge(state.where("tag = 0").unionByName(scored.where("tag = 1")), min(blocks, parts), parts, dim, kind, size, k), "pools", "tag")
        answers.append(materialise(after.where("tag = 2"), "answers"))
        discard(spark, folders(state) | (folders(seen) if seen is not None else set()))
        state, seen = after, scored
        release(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, cell in _runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cell(0, np.int64)), pa.array(cell(1, np.int64)), pa.array(cell(2, float))], ["node", "nbr", "score"])

    schema = "node long, nbr long, score double"
    return map_arrow(functools.reduce(DataFrame.unionByName, answers), run, schema) if answers else spark.createDataFrame([], schema)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For every row whose id is divisible by ``every``, its ``k`` nearest others: query_id, rank, vec_id, score.

    Nodes are named by a 64-bit hash of the vector.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("v"))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    v = v.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(element)))  # one zero
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["n"]
    rows = v.where(F.size("v") == dim).withColumn("node", F.xxhash64("v"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            vecs = batch.column(2)
            x = vecs.flatten().to_numpy().astype(kind).reshape(-1, dim)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.sqrt((x.astype(float) ** 2).sum(1)))], ["id", "node", "vec", "norm"])

        return step

    packed = materialise(map_batches(rows.select("id", "node", "v"), make, "id long, node long, vec binary, norm double").distinct(), "vectors")
    nodes = materialise(packed.groupBy("node").agg(F.first("vec").alias("vec"), F.max("norm").alias("norm")), "nodes")
    n, norms = nodes.agg(F.count("*"), F.percentile_approx("norm", [0.5, 0.9, 0.99, 1.0])).first()
    nodes = nodes.select("node", "vec")
    graph = materialise(_start(nodes, n, dim, kind, norms or [0.0]), "graph")
    changed = 1.0
    while changed >= CHANGED:
        before, graph = graph, materialise(_descend(graph, nodes, dim, kind), "graph")
        changed = _changed(before, graph)
        discard(spark, {f.rsplit("/", 1)[0] for f in before.inputFiles()})
        release(spark)
    asked = packed.where(F.col("id") % every == 0).select("id", "node")
    found = _search(asked.select("node").distinct(), graph, nodes, asked.select("node").distinct().count(), n, dim, kind, pool_size(n), k + 1)

    # a node's answer holds k + 1 rows, as a query leaves itself out; no node gives more than so many members
    by_id = W.Window.partitionBy("node").orderBy("id")
    members = packed.select("node", "id").withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).select(F.col("node").alias("nbr"), F.col("id").alias("vec_id"))
    found = found.join(members, "nbr")
    by_score = W.Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    answers = found.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1)
    answers = answers.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("rows"))
    own = asked.join(answers, "node").select(F.col("id").alias("query_id"), F.slice(F.filter("rows", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("rows"))
    return own.select("query_id", F.posexplode("rows").alias("k", "e")).select("query_id", (F.col("k") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")
