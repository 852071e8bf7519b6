"""Jaccard join of word shingles with count vectors in R-trees.

The shingles of a document are hashed into groups, and the counts of the groups are its point.  For two
points the sum of the smaller coordinates bounds the shared shingles from above, and for a box of points
the sum over the box's upper corner does; subtrees below the overlap that the similarity needs are not
entered.  What survives is verified on the full shingle sets.

At the top the tree is split by rare shingles: documents that can link share one of their
``n - ceil(t n) + 1`` rarest shingles (rare by counts of 2**16 hash slots over all documents, then by
hash).  A pure box tree over all documents would not separate long documents: their counts are too alike.
Documents with one shingle set are one point.  A rare shingle of very many documents is cut into pages;
rounds of search, verification and components follow, in which only points of different components meet,
until no unverified pair is left, so no link is lost and a dense group never emits all its pairs.  A pair
belongs to the smallest bucket that its documents share, and no other bucket emits it.  The sets
themselves never move as a whole: a round first bounds its new pairs by finer counts, whose number follows the
size of the set, and makes only the sets of the pairs that pass; counts and sets are made again from the texts, chosen
by a filter of ``MEMBERS`` bits that only saves work, as the pairs are joined with them exactly.

A shingle is a run of ``size`` words, lower-cased A-Z; a shorter text is one shingle.  Shingles are
compared by 64-bit hash.

Defined cases: a text without words, null or empty, has no shingle and is its own component; repeated
rows share a result, and of rows with one doc_id and different texts one stands for all; a null doc_id
has no component; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import sieve
from chronoweave.llm import text as tx
from chronoweave.llm.graph import components
from chronoweave.storage import few, materialise, release

SLOTS = 1 << 16  # of the shingle counts over all documents
MEMBERS = 1 << 23  # bits of the filter that says whose sets a round needs
GROUPS = 128  # coordinates of a point
PAGE = 1024  # points of a tree
LEAF, FAN = 16, 8
SPARE = 4  # a large page may emit SPARE ** (2 * round) pairs per point besides a spanning forest
FULL = 65535  # a count that no longer fits
BYTE = 255  # the same of a sketch
OWNERS = 8  # smallest buckets that a document's row names


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = tx.LOWER[data]
    starts, ends = tx.word_spans(data, offsets)
    words = tx.span_hash(tx.prefix_hash(data), starts, ends)
    grams = tx.gram_hash(words, size)
    at = np.searchsorted(starts, offsets)
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        else:
            out.append(tx.gram_hash(words[lo:hi], hi - lo) if hi > lo else grams[:0])
    return out


def _runs(batch: pa.RecordBatch, size: int):
    """doc_id and shingles of short runs of rows, so that a task never holds the sets of a whole batch."""
    for lo, hi, data, offsets in tx.slices(batch.column("text")):
        yield batch.column("doc_id").slice(lo, hi - lo), shingles(data, offsets, size)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def _frequency_batches(size: int):
    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, data, offsets in tx.slices(batch.column("text")):
                starts, ends = tx.word_spans(data, offsets)
                row = tx.rows_of(starts, offsets)
                grams = tx.gram_hash(tx.span_hash(tx.prefix_hash(tx.LOWER[data]), starts, ends), size)
                total += np.bincount(_slot(grams[row[: len(grams)] == row[size - 1 :]] if len(grams) else grams), minlength=SLOTS)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    return run


POINTS = "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, point binary"


def identity(found: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that stand for a set."""
    a, b = tx.mix(found ^ np.uint64(0x5851F42D4C957F2D)), tx.mix(found + np.uint64(0x14057B7EF767814F))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64))


def identities(flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``identity`` of many sets that lie one after the other from ``edges`` on."""
    a, b = tx.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), tx.mix(flat + np.uint64(0x14057B7EF767814F))
    return np.add.reduceat(a, edges).view(np.int64), np.add.reduceat(b, edges).view(np.int64)


def point(found: np.ndarray) -> bytes:
    """Counts of a set's groups in few bytes: the groups themselves if they are fewer than the counts, else counts
    of one byte, or of two if one does not hold them."""
    group = (found & np.uint64(GROUPS - 1)).astype(np.uint8)
    if len(found) < GROUPS:
        return group.tobytes()
    counts = np.minimum(np.bincount(group, minlength=GROUPS), FULL)
    return counts.astype("u1" if counts.max() < 256 else "<u2").tobytes()


def counts_of(points: list[bytes]) -> np.ndarray:
    """The counts of several points, one row each; a count that no longer fits bounds nothing."""
    lengths = np.array([len(p) for p in points])
    out = np.zeros((len(points), GROUPS), np.int32)
    for length, kind in ((GROUPS, "u1"), (2 * GROUPS, "<u2")):
        at = np.flatnonzero(lengths == length)
        if len(at):
            out[at] = np.frombuffer(b"".join([points[i] for i in at]), kind).reshape(len(at), GROUPS)
    out[out == FULL] = 1 << 30
    few = np.flatnonzero(lengths < GROUPS)
    groups = np.frombuffer(b"".join([points[i] for i in few]), np.uint8)
    np.add.at(out, (np.repeat(few, lengths[few]), groups), 1)
    return out


def sketch(found: np.ndarray) -> bytes:
    """Counts of a set's groups in one byte each, one to two shingles a group however large the set is."""
    groups = max(GROUPS, 1 << (len(found).bit_length() - 1))
    return np.minimum(np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups), BYTE).astype("u1").tobytes()


def sketch_bound(x: bytes, y: bytes) -> int:
    """At least as many shingles as the sets of two sketches share; the finer sketch is folded to the groups of the other."""
    a, b = (np.frombuffer(s, np.uint8).astype(np.int64) for s in sorted((x, y), key=len))
    a[a == BYTE], b[b == BYTE] = 1 << 30, 1 << 30
    return int(np.minimum(a, b.reshape(-1, len(a)).sum(0)).sum())


def prefix_length(n: int, share: tuple[int, int]) -> int:
    return n - -(-share[0] * n // share[1]) + 1


def _point_batches(size: int, share: tuple[int, int], frequency: np.ndarray):
    def run(batches):
        names = [c.split()[0] for c in POINTS.split(", ")]
        for ids, sets in (r for batch in batches for r in _runs(batch, size)):
            rows, keys, lengths, points = [], [], [], []
            for found in sets:
                n = len(found)
                rows.append((n, *identity(found)))
                rare = np.argsort(frequency[_slot(found)], kind="stable")[: prefix_length(n, share)] if n else []
                keys.append(found[rare] if n else found)
                lengths.append(len(keys[-1]))
                points.append(point(found) if n else None)
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 3)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, *cols, lists, pa.array(points, pa.binary())], names)

    return run


def _bucket_batches(batches):
    """Runs of equal keys: documents that share one; equal document lists of a batch get one number.

    A key of more than ``PAGE`` documents is cut into pages; its number is the key.  A key met once ends here.
    """

    def runs(keys, docs, page):
        """Rows of complete runs; the first run's pages start at ``page``."""
        edges = np.append(np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys))
        lengths = np.diff(edges)
        base = np.zeros(len(lengths), np.int64)
        base[0] = page
        hot = (lengths > PAGE) | (base > 0)
        lists = np.add.reduceat(tx.mix(docs.view(np.uint64)), edges[:-1])
        names = np.where(hot, keys[edges[:-1]], tx.mix(lists + lengths.astype(np.uint64)).view(np.int64))
        keep = np.flatnonzero((lengths > 1) | hot)
        keep = keep[np.unique(names[keep], return_index=True)[1]]
        at = np.repeat(edges[:-1][keep] - np.cumsum(lengths[keep]) + lengths[keep], lengths[keep]) + np.arange(lengths[keep].sum())
        place = at - np.repeat(edges[:-1][keep], lengths[keep])
        pages = np.repeat(base[keep], lengths[keep]) + place // PAGE
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names[keep], lengths[keep])), pa.array(pages), pa.array(docs[at])], ["bucket", "page", "doc_id"])

    none = np.zeros(0, np.int64)
    keys, docs, page = none, none, 0
    for batch in batches:
        keys, docs = np.append(keys, np.asarray(batch.column("key"))), np.append(docs, np.asarray(batch.column("doc_id")))
        other = np.flatnonzero(keys != keys[-1]) if len(keys) else none
        last = int(other[-1]) + 1 if len(other) else 0  # the last run may go on
        if last:
            yield runs(keys[:last], docs[:last], page)
            keys, docs, page = keys[last:], docs[last:], 0
        if len(keys) > PAGE:  # a hot key that goes on: whole pages leave, the rest waits
            whole = len(keys) - len(keys) % PAGE
            yield pa.RecordBatch.from_arrays([pa.array(keys[:whole]), pa.array(page + np.arange(whole) // PAGE), pa.array(docs[:whole])], ["bucket", "page", "doc_id"])
            keys, docs, page = keys[whole:], docs[whole:], page + whole // PAGE
    if len(keys):
        yield runs(keys, docs, page)


class Tree:
    """R-tree over points: levels of upper corners and smallest sizes, leaves first."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-points.var(0))[:2]
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]] // 4, sizes // max(1, int(sizes.max()) // 8)))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        upper, least, fan = self.points, self.sizes, LEAF
        while len(upper) > 1:
            edges = np.arange(0, len(upper), fan)
            upper, least, fan = np.maximum.reduceat(upper, edges), np.minimum.reduceat(least, edges), FAN
            self.levels.append((upper, least))

    def pairs(self, points: np.ndarray, sizes: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, bound) of all entries whose bound reaches the overlap that the similarity needs."""

        def passing(q, node, upper, least):
            keep = [np.zeros(0, np.int64)]
            bounds = [np.zeros(0, np.int64)]
            for lo in range(0, len(q), 4096):
                a, b = q[lo : lo + 4096], node[lo : lo + 4096]
                bound = np.minimum(points[a], upper[b]).sum(1)
                ok = bound * (share[0] + share[1]) >= share[0] * (sizes[a] + least[b])
                keep.append(np.flatnonzero(ok) + lo)
                bounds.append(bound[ok])
            at = np.concatenate(keep)
            return q[at], node[at], np.concatenate(bounds)

        q, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[depth]
            if depth < len(self.levels) - 1:
                q, node = self._down(q, node, FAN, len(upper))
            q, node, _ = passing(q, node, upper, least)
        if self.levels:
            q, node = self._down(q, node, LEAF, len(self.points))
        q, node, bound = passing(q, node, self.points, self.sizes)
        return q, self.order[node], bound

    @staticmethod
    def _down(q: np.ndarray, node: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        child = (node[:, None] * fan + np.arange(fan)).ravel()
        ok = child < n
        return np.repeat(q, fan)[ok], child[ok]


def _forest(q: np.ndarray, c: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what is not yet connected by earlier ones."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    out = []
    for a, b in zip(q.tolist(), c.tolist()):
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def named(column: pa.ListArray) -> np.ndarray:
    """The ``OWNERS`` smallest buckets of each row in order, and how many there are in the last column."""
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), OWNERS + 1), np.int64)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), place] = np.asarray(column.flatten())
    out[:, OWNERS] = lengths
    return out


def owned(left: np.ndarray, right: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which pairs of rows of ``named`` belong to the bucket they were met in.

    If the two lists share a bucket, the smallest one is the smallest shared by the documents.  If they share none,
    which takes a document of more than ``OWNERS`` buckets, every bucket of the pair may emit it.
    """
    out = np.zeros(len(left), bool)
    for lo in range(0, len(left), 4096):
        a, b = left[lo : lo + 4096], right[lo : lo + 4096]
        inside = np.arange(OWNERS) < a[:, OWNERS:], np.arange(OWNERS) < b[:, OWNERS:]
        same = (a[:, :OWNERS, None] == b[:, None, :OWNERS]) & inside[0][:, :, None] & inside[1][:, None, :]
        common = same.any(2)
        least = a[np.arange(len(a)), common.argmax(1)]
        out[lo : lo + 4096] = ~common.any(1) | (least == bucket[lo : lo + 4096])
    return out


def candidates(points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, share: tuple[int, int], limit: int, owners: np.ndarray, bucket: np.ndarray) -> tuple[list, bool]:
    """Pairs of a large page in different components that belong to its bucket: a spanning forest, and
    further ones up to ``limit``; and whether pairs were left out."""
    tree, label = Tree(points, sizes), comps.copy()
    forest, others, n = [], [], 0
    for lo in range(0, len(points), 64):
        q, c, _ = tree.pairs(points[lo : lo + 64], sizes[lo : lo + 64], share)
        q = q + lo
        ok = (c > q) & (comps[q] != comps[c])
        q, c = q[ok], c[ok]
        ok = owned(owners[q], owners[c], bucket[q])
        q, c = q[ok], c[ok]
        if n < limit:
            others.append(np.stack([q, c], 1)[: limit - n])
        n += len(q)
        for one in np.unique(q):
            at = c[(q == one) & (label[c] != label[one])]
            if len(at):
                at = at[np.unique(label[at], return_index=True)[1]]
                forest += [(int(one), int(x)) for x in at]
                label[np.isin(label, label[at])] = label[one]
    chosen = {*forest, *(tuple(x) for part in others for x in part.tolist())}
    return list(chosen), n > len(chosen)


def _small_pairs(points, sizes, comps, edges, share, owners, bucket):
    """Passing pairs (by smaller entry) in different components that belong to one of the small groups of a chunk."""
    lengths = np.diff(edges)
    left, right = [], []
    for m in np.unique(lengths[lengths > 1]):
        a, b = np.triu_indices(m, 1)
        at = edges[:-1][lengths == m][:, None]
        left.append((at + a).ravel())
        right.append((at + b).ravel())
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, c = np.concatenate(left), np.concatenate(right)
    ok = comps[q] != comps[c]
    # The smaller size bounds the overlap, too.
    ok &= np.minimum(sizes[q], sizes[c]) * (share[0] + share[1]) >= share[0] * (sizes[q] + sizes[c])
    q, c = q[ok], c[ok]
    ok = owned(owners[q], owners[c], bucket[q])
    q, c = q[ok], c[ok]
    keep = []
    for lo in range(0, len(q), 4096):
        a, b = q[lo : lo + 4096], c[lo : lo + 4096]
        bound = np.minimum(points[a], points[b]).sum(1, dtype=np.int64)
        keep.append(bound * (share[0] + share[1]) >= share[0] * (sizes[a] + sizes[b]))
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    order = np.lexsort((c[keep], q[keep]))
    return q[keep][order], c[keep][order]


SMALL = 24  # up to so many points of a group all pairs are bounded at once
CHUNK = 8192
PAIRS = "a long, b long, bucket long"


def _page_batches(share: tuple[int, int], round_: int):
    """Candidate pairs of sorted pages; a row with a bucket alone says that pairs of it are left for later."""

    def settle(bucket, group, docs, sizes, comps, owners, points):
        points = counts_of(points)
        same = (group[1:] == group[:-1]).all(1)
        keep = np.append(True, ~(same & (docs[1:] == docs[:-1])))
        bucket, group, docs, sizes, comps, owners, points = (x[keep] for x in (bucket, group, docs, sizes, comps, owners, points))
        edges = np.append(np.append(0, np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1), len(docs))
        lengths = np.diff(edges)
        found, again = [], []
        small = np.flatnonzero(lengths <= SMALL)
        if len(small):
            at = np.concatenate([np.arange(edges[g], edges[g + 1]) for g in small])
            bounds = np.append(0, np.cumsum(lengths[small]))
            q, c = _small_pairs(points[at], sizes[at], comps[at], bounds, share, owners[at], bucket[at])
            chosen = _forest(q, c) if round_ == 0 else list(zip(q.tolist(), c.tolist()))
            found += [(docs[at[a]], docs[at[b]]) for a, b in chosen]
            if round_ == 0 and len(chosen) < len(q):
                owner = np.searchsorted(bounds, q, "right")
                held = np.bincount(owner, minlength=len(bounds) + 1) - np.bincount(np.searchsorted(bounds, [a for a, _ in chosen], "right"), minlength=len(bounds) + 1)
                again += bucket[at[bounds[np.flatnonzero(held > 0) - 1]]].tolist()
        for g in np.flatnonzero(lengths > SMALL):
            part = slice(edges[g], edges[g + 1])
            limit = SPARE ** (2 * round_) * int(lengths[g]) if round_ else 0
            chosen, more = candidates(points[part], sizes[part], comps[part], share, limit, owners[part], bucket[part])
            found += [(docs[edges[g] + a], docs[edges[g] + b]) for a, b in chosen]
            if more:
                again.append(int(bucket[edges[g]]))
        again = sorted(set(again))
        a = [min(x, y) for x, y in found] + [None] * len(again)
        b = [max(x, y) for x, y in found] + [None] * len(again)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, [None] * len(found) + again)], ["a", "b", "bucket"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in ("bucket", "page", "side", "doc_id", "n_shingles", "component")]
            cols = [cols[0], np.stack(cols[:3], 1), *cols[3:], named(batch.column("owners")), batch.column("point").to_pylist()]
            held = cols if held is None else [x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(held, cols)]
            if len(held[0]) >= CHUNK:
                cut = np.flatnonzero((held[1] != held[1][-1]).any(1))
                if len(cut):
                    end = int(cut[-1]) + 1
                    yield settle(*(x[:end] for x in held))
                    held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield settle(*held)

    return run


SETS = "doc_id long, n_shingles long, s1 long, s2 long, shingles binary"


def _member(doc_id: str):
    return F.pmod(F.xxhash64(doc_id), F.lit(MEMBERS))


def _bits(members: DataFrame) -> np.ndarray:
    """The numbers of the column m as bits, ``MEMBERS`` of them at most."""
    words = members.groupBy(F.shiftright("m", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("m").bitwiseAND(32767)).alias("bits"))
    bits = np.zeros((MEMBERS >> 15, 4096), np.uint8)
    for k, part in few(words, MEMBERS >> 15).collect():
        bits[k] = np.frombuffer(part, np.uint8)
    return bits.ravel()


def _wanted(pairs: DataFrame) -> np.ndarray:
    """Bits of the documents in pairs."""
    return _bits(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).select(_member("doc_id").alias("m")))


def _set_batches(size: int, bits: np.ndarray, form: Callable[[np.ndarray], bytes]):
    def run(batches):
        for batch in batches:
            member = np.asarray(batch.column("member"))
            mine = np.flatnonzero(bits[member >> 3] >> (member & 7).astype(np.uint8) & 1)
            for ids, found in _runs(batch.take(pa.array(mine)), size):
                names = [identity(f) for f in found]
                cols = [pa.array([len(f) for f in found], pa.int64()), *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)), pa.array([form(f) for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "n_shingles", "s1", "s2", "shingles"])

    return run


LINKS = "a long, b long, linked boolean"


def _bound_batches(share: tuple[int, int]):
    def run(batches):
        for batch in batches:
            ok = []
            for n, x, y in zip(batch.column("n").to_pylist(), batch.column("sa"), batch.column("sb")):
                ok.append(sketch_bound(x.as_py(), y.as_py()) * (share[0] + share[1]) >= share[0] * n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return run


def _verify_batches(share: tuple[int, int]):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(share[1] * shared >= share[0] * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return run


def _search(members: DataFrame, points: DataFrame, labels: DataFrame | None, again: DataFrame | None, share: tuple[int, int], round_: int, scratch: list[DataFrame], n_rows: int) -> DataFrame:
    """Candidate pairs of a round; after the first only from buckets left open that hold several components.

    ``scratch`` gets the tables that are written for it; ``members`` has ``n_rows`` rows in the first round.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if again is not None:
        members = members.join(again, "bucket", "left_semi")
    if labels is None:
        rows = members.join(points, "doc_id").withColumn("component", F.col("doc_id")).withColumn("side", F.lit(0))
    else:
        labels = labels.withColumnRenamed("node", "doc_id")
        rows = members.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        rows = materialise(few(rows, n_rows), "members")
        held = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("last"))
        held = held.groupBy("bucket").agg(F.max_by("component", "n").alias("major"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max("last").alias("last"))
        held = materialise(few(held.where("n > most"), n_rows), "open_buckets")
        scratch += [rows, held]
        rows = rows.join(held, "bucket")
        minors = F.ceil((F.col("n") - F.col("most")) / PAGE)
        everyone = rows.withColumn("side", F.explode(F.sequence(F.lit(0), minors.cast("int") - 1)))
        minor = rows.where("component <> major").withColumn("side", F.pmod(F.xxhash64("doc_id"), minors).cast("int"))
        minor = minor.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        rows = everyone.unionByName(minor).join(points, "doc_id")
    rows = rows.select("bucket", "page", F.col("side").cast("long").alias("side"), "doc_id", "n_shingles", "component", "owners", "point")
    pages = rows.repartition(n, "bucket", "page", "side").sortWithinPartitions("bucket", "page", "side", "doc_id")
    return few(pages, n_rows, CHUNK).mapInArrow(_page_batches(share, round_), PAIRS)


def join(docs: DataFrame, size: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; ``share`` is the similarity as a fraction."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequency = np.zeros(SLOTS, np.int64)
    counted = body.select("text").mapInArrow(_frequency_batches(size), "slot long, n long").groupBy("slot").agg(F.sum("n"))
    for slot, n in few(counted, SLOTS).collect():  # at most SLOTS
        frequency[slot] = n
    made = materialise(body.mapInArrow(_point_batches(size, share, frequency), POINTS), "points")
    same = ["n_shingles", "s1", "s2"]
    narrow = materialise(made.select("doc_id", *same), "names")
    total = narrow.agg(F.count(F.lit(1)), F.sum(F.col("n_shingles") - F.ceil(F.col("n_shingles") * share[0] / share[1]) + 1)).first()
    rows, n_keys = total[0], int(total[1] or 0)
    classes = narrow.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    classes = materialise(few(classes.where("rep is not null"), rows), "classes")
    # Rows that stand for no set, or not alone for their doc_id; all others stay where they are.
    others = narrow.join(classes, same).where("rep <> doc_id").select("doc_id")
    others = others.unionByName(narrow.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    whole = made.where("doc_id is not null and n_shingles > 0")
    near, reps = sieve.sift(whole, sieve.slot(F.col("doc_id")), others.select(sieve.slot(F.col("doc_id")).alias("m")))
    near = near.join(classes.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same]).select(*made.columns)
    several = not near.groupBy("doc_id").count().where("count > 1").isEmpty()
    if several:
        first = Window.partitionBy("doc_id").orderBy("s1", "s2")
        near = near.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    reps = reps.unionByName(near)

    lean = reps.select(F.explode("keys").alias("key"), "doc_id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = lean.repartition(n, "key").sortWithinPartitions("key", "doc_id").mapInArrow(_bucket_batches, "bucket long, page long, doc_id long")
    members = materialise(few(few(runs, n_keys).distinct(), n_keys), "buckets")
    chosen = materialise(reps.select("doc_id", *same), "chosen") if several else None

    def made_again(pairs: DataFrame, form: Callable[[np.ndarray], bytes], scratch: list[DataFrame]) -> DataFrame:
        """Sets of the documents in pairs, and of few others, read from the texts again; ``scratch`` gets what is written."""
        sets = materialise(body.withColumn("member", _member("doc_id")).mapInArrow(_set_batches(size, _wanted(pairs), form), SETS), "sets")
        scratch.append(sets)
        if several:
            return sets.join(chosen, ["doc_id", *same], "left_semi").dropDuplicates(["doc_id"])
        return sets

    links = None
    if not members.isEmpty():
        points = materialise(few(reps.select("doc_id", "n_shingles", "point"), rows), "rep_points")
        release(made)
        links = _link_rounds(members, points, lambda p, s: made_again(p, np.ndarray.tobytes, s), share, lambda p, s: made_again(p, sketch, s))
        release(points)
    else:
        release(made)
    if several:
        release(chosen)
    if links is None:
        joined = narrow.join(classes, ["n_shingles", "s1", "s2"], "left")
        return joined.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("component_id"))
    joined = narrow.join(classes, ["n_shingles", "s1", "s2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    joined = joined.join(links.withColumnRenamed("node", "rep"), "rep", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


Maker = Callable[[DataFrame, list[DataFrame]], DataFrame]


def _meet(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with what both sides have in ``sets``."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "sa", "sb")


def _link_rounds(members: DataFrame, points: DataFrame, sets_of: Maker, share: tuple[int, int], sketches_of: Maker | None = None) -> DataFrame | None:
    """Search, verify and connect until every candidate pair in different components is verified.

    With ``sketches_of`` only pairs whose sketches pass are verified on their sets.
    """
    rows = members.count()
    wide = materialise(few(members.where("page > 0").select("bucket").distinct(), rows), "wide_buckets")
    first = F.slice(F.array_sort(F.collect_set("bucket")), 1, OWNERS).alias("owners")
    owners = materialise(few(members.groupBy("doc_id").agg(first), rows), "owners")
    points = points.join(owners, "doc_id")
    tested = labels = again = None
    round_ = 0
    while True:
        scratch: list[DataFrame] = []
        found = materialise(_search(members, points, labels, again, share, round_, scratch, rows), "pairs")
        n = found.count()
        pairs = found.where("bucket is null").select("a", "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialise(few(pairs, n), "new_pairs")
        again = found.where("bucket is not null").select("bucket").distinct()
        again = materialise(few(again.unionByName(wide).distinct() if round_ == 0 else again, n), "again")
        release(found, *scratch)
        if not pairs.isEmpty():
            scratch, passed, parts = [], pairs, [] if tested is None else [tested]
            if sketches_of is not None:
                bounded = few(_meet(pairs, sketches_of(pairs, scratch)), n, CHUNK // 2).mapInArrow(_bound_batches(share), LINKS)
                bounded = materialise(bounded, "bounded")
                release(*scratch)
                scratch, passed = [], bounded.where("linked").select("a", "b")
                parts.append(bounded.where("not linked"))
            if sketches_of is None or not passed.isEmpty():
                checked = few(_meet(passed, sets_of(passed, scratch)), n, CHUNK // 2).mapInArrow(_verify_batches(share), LINKS)
                parts.append(materialise(checked, "links"))
                release(*scratch)
            tested = functools.reduce(DataFrame.unionByName, parts)
            labels = materialise(components(tested.where("linked").select("a", "b")), "labels")
        release(pairs)
        if again.isEmpty():
            release(owners)
            return labels
        if labels is None:
            labels = members.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component")).distinct()
        round_ += 1
