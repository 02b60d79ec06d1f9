"""Documents whose word shingles overlap, and the groups that such links make."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm import text as T
from tablecraft.llm.columns import beside, kind
from tablecraft.llm.components import components
from tablecraft.llm.storage import cut

U = np.uint64
SHINGLE, PERCENT = 5, 80
#: Groups of shingles whose counts make a point, in trees and (about one for two shingles, at most) for single pairs.
GROUPS, FINE_GROUPS = 128, 16_384
#: Fewest and most bits beside a set's counts, in between the next power of two to its size; each tells whether an odd number of its shingles
#: falls on it.
PARITIES = 256, 16_384
#: Leading bits of a shingle's hash that make the buckets which tell frequent shingles from others.
BUCKET_BITS = 18
#: Members of a cell that one tree holds; entries of a leaf, and members of a cell up to which it is one leaf; partners that a member of a
#: larger cell is first checked against, and in the rounds after that.
BLOCK, LEAF, PARTNERS, ROUNDS = 4_096, 16, 2, (8,)
FULL = 255  # a counter at this value may stand for more
#: Sets of a cell, in bytes, that are compared in one place.
PIECE_BYTES = 16 << 20
#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 200_000


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, hashes of the different shingles sorted within each row, bounds of the rows) over whole texts. A text of
    fewer than k words, but some, has its whole sequence as its only shingle."""
    for i, j, w in T.word_slices(texts, T.BLANK_WORDS, True):
        h, size = w.hashes(), np.diff(w.at)
        inside = T.within(w.doc, k)
        parts, owners = [T.runs(h, k)[inside]], [w.doc[: len(inside)][inside]]
        for n in range(1, k):
            if len(rows := np.flatnonzero(size == n)):
                parts.append(T.mix(T.runs(h, n)[w.at[rows]] + U(n)))
                owners.append(rows)
        g, doc = np.concatenate(parts), np.concatenate(owners)
        order = np.lexsort((g, doc))
        g, doc = g[order], doc[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[new], doc[new]
        yield i, j, g, np.searchsorted(doc, np.arange(j - i + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


def fingerprints(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for a set, the same for equal sets."""
    return T.mix(sums(T.mix(g ^ U(0x51ED270B)), bounds) + np.diff(bounds).astype(np.uint64)).view(np.int64)


def points(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of each row's shingles by group, as far as 8 bits hold them."""
    rows = len(bounds) - 1
    cell = np.repeat(np.arange(rows), np.diff(bounds)) * GROUPS + (g % U(GROUPS)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=rows * GROUPS), FULL).astype(np.uint8).reshape(rows, GROUPS)


def parities(g: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each row and bit whether an odd number of the row's shingles falls on it."""
    size = np.diff(bounds)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), *PARITIES)
    at = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(size)), size)
    odd = np.bincount(at[row] + ((g >> U(20)).astype(np.int64) & (bits[row] - 1)), minlength=at[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[s:e] for s, e in zip((at[:-1] // 8).tolist(), (at[1:] // 8).tolist())]


class Parities:
    """Parities of points (counts, then parities), those of one width together; a point of counts alone has none, which bounds nothing."""

    def __init__(self, point):
        self.width = np.array([(len(p) - GROUPS) // 8 for p in point], np.int64)
        self.place, self.words = np.zeros(len(self.width), np.int64), {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self.place[rows] = np.arange(len(rows))
            self.words[w] = np.frombuffer(b"".join([point[r][GROUPS:] for r in rows]), U).reshape(len(rows), w)

    def of(self, rows, width: int, folded: int) -> np.ndarray:
        """Rows of one width, folded to a smaller one."""
        words = self.words[width][self.place[rows]]
        while words.shape[-1] > folded:
            half = words.shape[-1] // 2
            words = words[..., :half] ^ words[..., half:]
        return words

    def differing(self, rows: np.ndarray, other: Parities, others) -> np.ndarray:
        """In how many bits rows differ from rows (or one row) of another: each has at least one shingle that only one of two sets has."""
        out = np.zeros(len(rows), np.int64)
        a, b = self.width[rows], np.broadcast_to(other.width[others], len(rows))
        for v, w in {*zip(a.tolist(), b.tolist())}:
            some = np.flatnonzero((a == v) & (b == w))
            theirs = others[some] if np.ndim(others) else others
            low = min(v, w)
            out[some] = np.bitwise_count(self.of(rows[some], v, low) ^ other.of(theirs, w, low)).sum(-1, dtype=np.int64)
        return out


def fine_point(g: np.ndarray) -> np.ndarray:
    """Counts of one set by as many groups, a power of two, as keep unrelated sets of its size apart."""
    groups = min(FINE_GROUPS, max(GROUPS, 1 << int(len(g) // 2).bit_length()))
    return np.minimum(np.bincount((g % U(groups)).astype(np.int64), minlength=groups), FULL).astype(np.uint8)


def fine_bound(a: np.ndarray, b: np.ndarray) -> int | None:
    """Most common shingles by two fine points, the finer one folded to the other's groups; None if full counters hide it."""
    if a.max() == FULL or b.max() == FULL:
        return None
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int(np.minimum(a, b.reshape(-1, len(a)).sum(0, dtype=np.int64)).sum())


def may_share(x: bytes, y: bytes) -> bool:
    """Whether two fine points allow enough common shingles."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    bound = fine_bound(a, b)
    return bound is None or bool(enough(bound, int(a.sum(dtype=np.int64)), int(b.sum(dtype=np.int64))))


def do_share(x: bytes, y: bytes) -> bool:
    """Whether two whole sets share enough."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    p, q = (p, q) if len(p) < len(q) else (q, p)
    return bool(enough(int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()), len(p), len(q)))


def stacked(point) -> np.ndarray:
    """The counts of points."""
    return np.frombuffer(b"".join([p[:GROUPS] for p in point]), np.uint8).reshape(len(point), GROUPS)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most so many common shingles have points a and b (broadcast): the sum of the smaller coordinates; a full counter bounds nothing."""
    bound = np.minimum(a, b).sum(-1, dtype=np.int64)
    return np.where((a.max(-1) == FULL) & (b.max(-1) == FULL), np.iinfo(np.int64).max // 1000, bound)


def enough(common, size_a, size_b, percent: int = PERCENT):
    """100 * intersection >= percent * union, for `common` shared shingles."""
    return (100 + percent) * common >= percent * (size_a + size_b)


def few_apart(differing, size_a, size_b):
    """Whether sets whose parities differ in so many bits may share enough."""
    return enough((size_a + size_b - differing) // 2, size_a, size_b)


class Tree:
    """An R-tree over the points of one cell, packed in the order of size: a leaf keeps the largest coordinates and the sizes it spans,
    and a branch those of its leaves. Parities, which have no order, bound the pairs that are left."""

    def __init__(self, point: np.ndarray, size: np.ndarray, odd: Parities | None = None):
        self.point, self.size, self.odd = point, size, odd
        self.levels = []
        top, low = point, size
        while len(top) > LEAF:
            at = np.arange(0, len(top), LEAF)
            top, low = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at)
            self.levels.append((top, low))

    def partners(self, i: int) -> np.ndarray:
        """Members that can share enough with member i, itself included."""
        return self.partners_of(self.point[i], self.size[i], self.odd, i)

    def partners_of(self, me: np.ndarray, mine: int, odd: Parities | None = None, row: int = 0) -> np.ndarray:
        """Members that can share enough with a set, whose parities are a row of `odd`. Whole branches fall when the sum of smaller
        coordinates is too small."""
        found = None
        for top, low in reversed(self.levels):
            at = np.arange(len(top)) if found is None else (found[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(top)]
            found = at[enough(overlap_bound(top[at], me), np.maximum(low[at], -(-PERCENT * mine // 100)), mine)]
        at = np.arange(len(self.point)) if found is None else (found[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.point)]
        at = at[100 * np.minimum(self.size[at], mine) >= PERCENT * np.maximum(self.size[at], mine)]
        at = at[enough(overlap_bound(self.point[at], me), self.size[at], mine)]
        if odd is None or self.odd is None or not len(at):
            return at
        return at[few_apart(self.odd.differing(at, odd, row), self.size[at], mine)]


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles of all documents fall into each of 2 ** BUCKET_BITS buckets: frequent shingles stand out at any corpus size."""

    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, _, g, _ in shingle_sets(batch.column(0)):
                total += np.bincount((g >> U(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    got = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a fixed number of rows
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, size, point) of every row; node is the fingerprint of the set, missing where the text has no words."""

    def work(batches):
        for batch in batches:
            for i, j, g, bounds in shingle_sets(batch.column(1)):
                size = np.diff(bounds)
                own = [batch.column(c).slice(i, j - i) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(fingerprints(g, bounds), mask=size == 0), pa.array(size), pa.array([c.tobytes() + o for c, o in zip(points(g, bounds), parities(g, bounds))], pa.binary())], ["doc_id", "th", "node", "size", "point"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(work, f"doc_id {kind(docs)}, th long, node long, size long, point binary")


def prefixes(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """(key, node, size): each set's first shingles in an order that puts frequent ones last. Sets that share enough share one of them."""
    shared = docs.sparkSession.sparkContext.broadcast(level)  # 2 ** BUCKET_BITS small numbers

    def work(batches):
        for batch in batches:
            for _, _, g, bounds in shingle_sets(batch.column(0)):
                size, f = np.diff(bounds), fingerprints(g, bounds)
                doc = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((g, shared.value[(g >> U(64 - BUCKET_BITS)).astype(np.int64)], doc))
                rank = np.arange(len(g)) - bounds[doc]
                first = rank < (size - -(-PERCENT * size // 100) + 1)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(g[order][first].view(np.int64)), pa.array(f[doc[first]]), pa.array(size[doc[first]].astype(np.int32))], ["key", "node", "size"])

    return docs.select("text").mapInArrow(work, "key long, node long, size int")


def sorted_cells(batches, columns: int) -> Iterator[tuple[list[np.ndarray], bool | None]]:
    """Cells (runs of equal keys) of sorted batches: (columns, None) for all cells of up to LEAF rows of a batch side by side, (columns, True)
    for a larger cell, and (columns, False) for pieces of BLOCK rows of a still larger one, each with the cell's first row in front."""
    rest, lead = None, None

    def piece(rows):
        return [np.concatenate([x, y]) for x, y in zip(lead, rows)] if lead is not None else rows

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(columns)]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
        n = len(cols[0])
        if not n:
            continue
        edges = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1], True])
        first = 0
        if lead is not None and cols[0][0] != lead[0][0]:  # its pieces used up all its rows
            lead = None
        if lead is not None and len(edges) > 2:  # the cell that was handed on in pieces ends here
            if edges[1]:
                yield piece([c[: edges[1]] for c in cols]), False
            lead, first = None, 1
        sizes = np.diff(edges)[first:-1]
        starts = edges[first:-2]
        few = np.repeat(sizes <= LEAF, sizes)
        if few.any():
            at = np.flatnonzero(few) + (starts[0] if len(starts) else 0)
            yield [c[at] for c in cols], None
        for s, k in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
            yield [c[s : s + k] for c in cols], True
        rest = [c[edges[-2] :] for c in cols]
        while len(rest[0]) >= BLOCK:
            part, rest = [c[:BLOCK] for c in rest], [c[BLOCK:] for c in rest]
            yield piece(part), False
            if lead is None:
                lead = [c[:1] for c in part]
    if rest is not None and len(rest[0]):
        yield piece(rest), False if lead is not None else (None if len(rest[0]) <= LEAF else True)


def shared_cells(keyed: DataFrame) -> DataFrame:
    """Rows of keys that at least two different sets have, but for members with no other of near size. Sorted by Spark and read in order:
    no key is collected. A cell of less than BLOCK members is named by them, so cells of the same members, as a common passage makes many,
    are one; their rows come more than once."""

    def work(batches):
        tail = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            key, node, size = now if tail is None else [np.concatenate([a, b]) for a, b in zip(tail, now)]
            # Rows are in the order of key, size, node. The last two different rows wait for what follows them.
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, size = key[new], node[new], size[new]
            near = (key[1:] == key[:-1]) & (100 * size[:-1].astype(np.int64) >= PERCENT * size[1:].astype(np.int64))
            good = np.r_[False, near] | np.r_[near, False]
            start = 0 if tail is None else 1  # the first waiting row was judged with its neighbours before
            stop = max(start, len(key) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c[start:stop][good[start:stop]]) for c in (key, node, size)], ["key", "node", "size"])
            tail = [c[max(0, len(key) - 2) :] for c in (key, node, size)] if len(key) > 1 else [key, node, size]
            if len(key) == 1 and start == 0:
                tail = [np.r_[key[:1] ^ np.int64(1), key], np.r_[node[:1], node], np.r_[size[:1], size]]
        if tail is not None and len(tail[0]) > 1:
            key, node, size = tail
            if key[0] == key[1] and node[0] != node[1] and 100 * int(size[0]) >= PERCENT * int(size[1]):
                yield pa.RecordBatch.from_arrays([pa.array(c[1:]) for c in (key, node, size)], ["key", "node", "size"])

    def named(batches):
        for (key, node, size), whole in sorted_cells(work(batches), 3):
            if whole is not False:
                edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
                key = np.repeat(fingerprints(node.view(U), edges), np.diff(edges))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, node, size)], ["key", "node", "size"])

    return keyed.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(named, "key long, node long, size int")


def first_pairs(cells: DataFrame) -> DataFrame:
    """(a, b, cell, open): pairs that the bound leaves over, with their cell. A cell of up to LEAF members is one leaf, whose pairs are bounded
    side by side with those of other cells. A larger one gets a tree, and each of its members at most PARTNERS + 1 pairs, the first and others
    in a hashed order; where that leaves a pair out, a row without a and b names the cell as open."""

    def pairs(x, y, key):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(key), pa.nulls(len(x), pa.int64())], ["a", "b", "cell", "open"])

    def leaves(key, node, size, point):
        counts, odd = stacked(point), Parities(point)
        for step in range(1, LEAF):
            at = np.flatnonzero(key[step:] == key[:-step])
            if not len(at):
                return
            at = at[100 * size[at] >= PERCENT * size[at + step]]  # sizes ascend within a cell
            at = at[enough(overlap_bound(counts[at], counts[at + step]), size[at], size[at + step])]
            at = at[few_apart(odd.differing(at, odd, at + step), size[at], size[at + step])]
            if len(at):
                yield pairs(node[at], node[at + step], key[at])

    def grown(key, node, size, point, whole):
        tree, a, b, more = Tree(stacked(point), size, Parities(point)), [], [], not whole
        for i in range(len(node)):
            others = tree.partners(i)
            others = others[others != i]
            if len(others) > PARTNERS + 1:
                more = True
                order = np.argsort(T.mix(node[others].view(np.uint64) ^ T.mix(node[i : i + 1].view(np.uint64))))
                others = np.r_[others[:1], others[order[:PARTNERS]]]
            a.append(np.full(len(others), node[i]))
            b.append(node[others])
        a = np.concatenate(a)
        yield pairs(a, np.concatenate(b), np.full(len(a), key[0]))
        if more:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array(key[:1]), pa.array(key[:1])], ["a", "b", "cell", "open"])

    def work(batches):
        for (key, node, size, point), whole in sorted_cells(batches, 4):
            size = size.astype(np.int64)
            yield from leaves(key, node, size, point) if whole is None else grown(key, node, size, point, whole)

    return cells.select("key", "node", "size", "point").repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(work, "a long, b long, cell long, open long")


def pairs_apart(members: DataFrame) -> DataFrame:
    """(a, b, cell): pairs of a cell's members in two components that the bound leaves over, from members (key, node, size, point, root).

    A cell is dealt in pieces of about BLOCK members by a hash of the node, and each piece grows a tree. The members outside the cell's largest
    component ask the tree of every piece for partners of other components, one after the other; what they are bounded against never becomes
    rows."""
    share = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "root"))["root"].alias("major"), F.count("*").alias("roots"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("pieces"))
    apart = members.join(small(cut(share.where("roots > 1"))), "key")
    own = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("pieces")).cast("int")
    apart = apart.select("key", "node", "size", "point", "root", own.alias("own"), "pieces", (F.col("root") != F.col("major")).alias("asks"))
    others = F.array_except(F.sequence(F.lit(0), F.col("pieces") - 1), F.array("own"))
    asking = apart.where("asks AND pieces > 1").select("key", F.explode(others).alias("piece"), F.lit(1).alias("guest"), "node", "size", "point", "root", "asks")
    rows = apart.select("key", F.col("own").alias("piece"), F.lit(0).alias("guest"), "node", "size", "point", "root", "asks").union(asking)

    def pairs(x, y, key):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.full(len(x), key))], ["a", "b", "cell"])

    def work(batches):
        at, held, tree = None, [], None

        def answers(node, size, point, root):
            """Pairs of these members with partners of other components in the present piece."""
            if tree is None:
                return
            nodes, roots = held[0], held[3]
            a, b, n = [], [], 0
            counts, odd = stacked(point), Parities(point)
            for i in range(len(node)):
                found = tree.partners_of(counts[i], size[i], odd, i)
                found = found[roots[found] != root[i]]
                a.append(np.full(len(found), node[i]))
                b.append(nodes[found])
                n += len(found)
                if n > BLOCK:
                    yield pairs(np.concatenate(a), np.concatenate(b), at[0])
                    a, b, n = [], [], 0
            if n:
                yield pairs(np.concatenate(a), np.concatenate(b), at[0])

        def closed():
            """The members of a piece are complete: its tree, and what its own members ask."""
            nonlocal tree, held
            held = [np.concatenate(c) for c in zip(*held)]
            tree = Tree(stacked(held[2]), held[1], Parities(held[2]))
            asks = held[4]
            yield from answers(*(c[asks] for c in held[:4]))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, piece, guest, node, size, root, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3, 4, 6, 7))
            point = batch.column(5).to_numpy(zero_copy_only=False)
            size = size.astype(np.int64)
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (piece[1:] != piece[:-1]) | (guest[1:] != guest[:-1]), True])
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if at != (key[s], piece[s]):
                    if tree is None and held:
                        yield from closed()
                    at, held, tree = (key[s], piece[s]), [], None
                part = node[s:e], size[s:e], point[s:e], root[s:e], asks[s:e].astype(bool)
                if not guest[s]:
                    held.append(part)
                else:
                    if tree is None and held:
                        yield from closed()
                    yield from answers(*part[:4])
        if tree is None and held:
            yield from closed()

    dealt = rows.repartition("key", "piece").sortWithinPartitions("key", "piece", "guest", "size", "node")
    return dealt.mapInArrow(work, "a long, b long, cell long")


def opened(nodes: DataFrame, docs: DataFrame, sets: DataFrame, form) -> DataFrame:
    """(node, value) for distinct `nodes`, value = form(set) as bytes; each is read from one of its documents."""

    def work(batches):
        for batch in batches:
            for i, j, g, bounds in shingle_sets(batch.column(1)):
                value = pa.array([form(g[s:e]).tobytes() for s, e in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), value], ["node", "value"])

    wanted = small(cut(sets.join(nodes, "node", "left_semi").select("node", F.col("rep").alias("_rep"), F.col("th").alias("_th"))))
    chosen = docs.withColumn("th", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("th") == F.col("_th")))
    return chosen.select("node", "text").mapInArrow(work, "node long, value binary").dropDuplicates(["node"])  # rows that repeat a document give the same


def gathered(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, cell) with a cell that most pairs of their neighbourhood have too: the smallest one that their ends reach in two
    steps. A cell is where values of pairs meet; it decides nothing."""
    for _ in range(2):
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "cell").groupBy("node").agg(F.min("cell").alias("least"))
        for side in ("a", "b"):
            pairs = pairs.join(ends.select(F.col("node").alias(side), F.col("least").alias(f"least_{side}")), side)
        pairs = pairs.select("a", "b", F.least("least_a", "least_b").alias("cell"))
    return cut(pairs)


def compared(pairs: DataFrame, docs: DataFrame, sets: DataFrame, form, test) -> DataFrame:
    """Of pairs (a, b, cell) those for whose values test(form(a), form(b)) holds.

    A value travels once to each cell in which it has pairs, not once for each pair. A cell whose sets are larger than PIECE_BYTES together
    is dealt in pieces by a hash of the node, and a value goes to the blocks of two pieces in which it has pairs."""
    ends = pairs.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    heavy = ends.join(sets.select("node", "size"), "node").groupBy("cell").agg(F.ceil(F.sum(F.col("size").cast("long") * 8) / PIECE_BYTES).cast("int").alias("pieces"))
    dealt = pairs.join(small(cut(heavy.where("pieces > 1"))), "cell", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    piece = [F.pmod(F.xxhash64(F.lit(3), c), F.col("pieces")) for c in ("a", "b")]
    dealt = dealt.select("cell", (F.least(*piece) * F.col("pieces") + F.greatest(*piece)).alias("block"), "a", "b")
    asked = dealt.select("cell", "block", F.explode(F.array("a", "b")).alias("node")).distinct()
    shipped = asked.join(opened(ends.select("node").distinct(), docs, sets, form), "node")
    none = F.lit(None)
    rows = shipped.select("cell", "block", F.lit(0).alias("kind"), F.col("node").alias("a"), none.cast("long").alias("b"), "value").union(
        dealt.select("cell", "block", F.lit(1), "a", "b", none.cast("binary")))

    def work(batches):
        at, held = None, {}
        for batch in batches:
            cell, block, kind, a = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            b, values = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False), batch.column(5)
            good = np.zeros(len(a), bool)
            for r in range(len(a)):
                if (cell[r], block[r]) != at:
                    at, held = (cell[r], block[r]), {}
                if kind[r] == 0:
                    held[a[r]] = values[r].as_py()
                else:
                    good[r] = test(held[a[r]], held[b[r]])
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good]), pa.array(cell[good])], ["a", "b", "cell"])

    return cut(rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(work, "a long, b long, cell long"))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that share enough: by fine points first, the rest by whole sets."""
    near = compared(gathered(pairs), docs, sets, fine_point, may_share)
    return compared(near, docs, sets, lambda g: g, do_share).select("a", "b")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles and component_id of every row of `docs` (doc_id, text, ...).

    Two documents link if 100 * |intersection| >= 80 * |union| of their sets of five-word shingles. Shingles are hashed to 128 groups, and
    the counts by group make a point; the summed smaller coordinates of two points bound the overlap of their sets, also for the largest
    coordinates of a branch in an R-tree.

    Points of unrelated texts of one length lie close in few dimensions and far in many, where a single tree over the corpus would compare
    nearly every leaf with every other. Trees are therefore grown per cell: equal sets are one node; nodes that share one of their first
    shingles, frequent ones last, share a cell, and each linked pair shares one. Trees propose pairs, pairs are verified on whole sets, and
    links make components. A member of a large cell is first checked against a few partners, then against more among those still in other
    components; in the end every pair of a cell that is still in two components is bounded and verified, so no link is lost, and copies are
    not expanded into all their pairs.

    Missing and empty texts have no shingles, no node and their own doc_id as component. Rows that repeat a text share a component; a row
    without doc_id takes part, but only ids name components. Other columns of `docs` are not read.
    """
    docs = docs.select("doc_id", "text")
    counts = bucket_counts(docs)
    level = np.floor(np.log2(np.maximum(1, counts / max(1.5 * counts.mean(), 1e-9)))).astype(np.uint8)
    per_row = cut(profiles(docs.where("text IS NOT NULL")))
    sets = per_row.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("component"), F.min(F.struct("doc_id", "th")).alias("rep"), F.first("size").cast("int").alias("size"), F.first("point").alias("point"))
    sets = cut(sets.select("node", "component", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("th"), "size", "point"))
    cells = shared_cells(prefixes(docs, level)).repartition("node").dropDuplicates(["key", "node"])
    cells = cells.join(sets.select("node", "point"), "node").select("key", "node", "size", "point").persist(StorageLevel.DISK_ONLY)
    found = cut(first_pairs(cells).groupBy("a", "b", "open").agg(F.min("cell").alias("cell")))
    tested = found.where("open IS NULL").select("a", "b", "cell")
    links = verified(tested, docs, sets)
    roots = cut(components(links))
    # Cells with pairs left out: everything that is still apart in them.
    open_cells = small(cut(found.where("open IS NOT NULL").select(F.col("open").alias("key")).distinct()))
    members = cells.join(open_cells, "key", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = cut(members)
    cells.unpersist()
    rest = cut(pairs_apart(members).groupBy("a", "b").agg(F.min("cell").alias("cell")).join(tested, ["a", "b"], "left_anti"))
    for partners in (*ROUNDS, None):
        if not rest.limit(1).count():
            break
        now = rest
        if partners is not None:  # a few partners each; most pairs are then in one component and need no look
            order = Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b")
            now = cut(rest.withColumn("n", F.row_number().over(order)).where(F.col("n") <= partners).select("a", "b", "cell"))
        links = verified(now, docs, sets)
        roots = cut(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)))
        if partners is not None:
            left = rest.join(now, ["a", "b"], "left_anti")
            for side in ("a", "b"):
                left = left.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r_{side}")), side, "left")
            rest = cut(left.where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b", "cell"))
    named = sets.select("node", "component").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("component").alias("component"))
    named = named.select("node", "root").join(ids, "root").select("node", "component")
    none = docs.where("text IS NULL").select("doc_id", F.xxhash64("text").alias("th"), F.lit(None).cast("long").alias("node"), F.lit(0).cast("long").alias("size"))
    rows = per_row.select("doc_id", "th", "node", "size").unionByName(none)
    return rows.join(named, "node", "left").select("doc_id", "th", F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


@beside(("doc_id", "text"), ())
def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near copies: of each group the document with the smallest doc_id, of equal rows one. Rows without
    doc_id in a group without any stay. Columns of `docs` may have any names and types; maps are equal if they list the same entries in the same
    order. An empty table gives an empty result."""
    groups = cut(jaccard_groups(docs).groupBy("doc_id", "th", "component_id").agg(F.count("*").alias("n")))
    first = groups.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("k.*")
    first = first.union(groups.where("component_id IS NULL").select("doc_id", "th"))
    first = small(cut(first.withColumnsRenamed({"doc_id": "_keep", "th": "_th"})))
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.xxhash64("text") == F.col("_th")), "left_semi")
    if not groups.where("n > 1").limit(1).count():
        return kept
    maps = [f.name for f in kept.schema if "map<" in f.dataType.simpleString()]  # cannot be compared as they are
    listed = {f"entries of {c}": F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in maps}
    keys = [c for c in kept.columns if c not in maps]
    return kept.withColumns(listed).dropDuplicates([*keys, *listed]).drop(*listed)


def op8_jaccard_join(docs: DataFrame) -> DataFrame:
    return jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")
