"""Ranked lexical search by branch and bound over trees of frequent terms.

A document is its restricted vector: the terms that any item asks for, most frequent first, with their
counts.  Every task sorts the vectors of a shard, so that documents with the same beginning share a path of
a prefix tree.  A node knows the largest count of each term and the smallest length norm below it; as a
score grows with counts and falls with the norm, these give a bound on every document below.  Each item
walks the tree depth first, best child first, and leaves out nodes whose bound cannot enter its ten best.
The ten best of all shards meet in a window.

Statistics count all documents.  Items are dealt into blocks of about ``BLOCK_TERMS`` terms; what a task
gets to know of a block is bounded by that, and a block is searched in all documents.

Defined cases: null and term-less texts are no documents; repeated rows, also of one ``doc_id``, are
documents of their own; a null ``doc_id`` comes last among equal scores; rows of one ``item_id`` (null
too) are one item; an item without terms has no row; further columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import text as tx
from chronoweave.storage import materialise

BLOCK_TERMS = 1 << 14  # distinct (item, term) pairs of a block of items, about
PAGE = 64  # documents of a leaf, unless their vectors are equal
SHARD_ENTRIES = 1 << 20  # entries of the vectors of one tree
CELLS = 1 << 22  # node x term cells of one tree, about
FOUND = "item_id long, score long, doc_id long"

TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, A-Z lower-cased, and the row of each."""
    inside = TERM[data]
    starts, ends = tx.spans_of(inside, offsets)
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    content = tx.LOWER[data[inside]]
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(content)])
    return terms, tx.rows_of(starts, offsets)


def _item_terms(batches):
    for batch in batches:
        for first, end, data, offsets in tx.slices(batch.column("text")):
            terms, row = terms_of(data, offsets)
            ids = batch.column("item_id").slice(first, end - first).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, terms.cast(pa.binary())], ["item_id", "term"])


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    places = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(values.astype(np.int32)))


def _restrict(vocabulary: list[bytes]):
    def run(batches):
        known = pa.array(vocabulary, pa.large_binary())
        for batch in batches:
            for first, end, data, offsets in tx.slices(batch.column("text")):
                terms, row = terms_of(data, offsets)
                at = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)
                asked = at >= 0
                cell, tf = np.unique(row[asked] * len(vocabulary) + at[asked], return_counts=True)
                doc, n = cell // len(vocabulary), end - first
                length = pa.array(np.bincount(row, minlength=n).astype(np.int64))
                parts = [batch.column("doc_id").slice(first, n), length, _lists(cell % len(vocabulary), doc, n), _lists(tf, doc, n)]
                yield pa.RecordBatch.from_arrays(parts, ["doc_id", "n", "terms", "tfs"])

    return run


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of weight adds for a term that occurs ``tf`` times."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """Prefix tree over sorted vectors; nodes are runs of documents."""

    def __init__(self, rank: np.ndarray, tf: np.ndarray, ptr: np.ndarray, m: np.ndarray, doc: np.ndarray, weight: np.ndarray):
        raw = rank.astype(">u4").tobytes()
        keys = [raw[4 * a : 4 * b] for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
        order = np.array(sorted(range(len(m)), key=keys.__getitem__), np.int64)
        size = np.diff(ptr)[order]
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(ptr[:-1][order] - self.ptr[:-1], size) + np.arange(self.ptr[-1])
        self.rank, tf, self.m, self.doc = rank[at], tf[at], m[order], doc[order]
        self.gain = gain(tf, np.repeat(self.m, size))
        self._grow()
        self._bound(tf, weight)

    def _grow(self) -> None:
        """Split runs at the first term in which they differ; neighbouring small branches share a leaf."""
        self.lo, self.hi, self.kids, self.above = [], [], [], []
        stack = [(0, len(self.m), -1)]
        while stack:
            lo, hi, above = stack.pop()
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.above.append(above)
            self.kids.append([])
            if above >= 0:
                self.kids[above].append(node)
            if hi - lo <= PAGE:
                continue
            a, b = (self.rank[self.ptr[d] : self.ptr[d + 1]] for d in (lo, hi - 1))
            k = min(len(a), len(b))
            depth = int(np.argmin(np.append(a[:k] == b[:k], False)))
            place = self.ptr[lo:hi] + depth
            ends = place >= self.ptr[lo + 1 : hi + 1]
            term = np.where(ends, -1, self.rank[np.minimum(place, len(self.rank) - 1)])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [hi - lo]])
            if len(cuts) == 2:
                continue  # equal vectors
            begin = 0
            for left, right in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if right - begin > PAGE and begin < left:
                    stack.append((lo + begin, lo + left, node))
                    begin = left
            stack.append((lo + begin, hi, node))

    def _bound(self, tf: np.ndarray, weight: np.ndarray) -> None:
        """Per node and term the most that the term can add to a document below."""
        nodes = len(self.lo)
        most = np.zeros((nodes, len(weight)), np.int64)
        least = np.full(nodes, np.iinfo(np.int64).max)
        for node in range(nodes - 1, -1, -1):
            if not self.kids[node]:
                a, b = self.ptr[self.lo[node]], self.ptr[self.hi[node]]
                np.maximum.at(most[node], self.rank[a:b], tf[a:b])
                least[node] = self.m[self.lo[node] : self.hi[node]].min()
            if (up := self.above[node]) >= 0:
                np.maximum(most[up], most[node], out=most[up])
                least[up] = min(least[up], least[node])
        self.most = weight * gain(most, least[:, None])
        self.kids = [np.array(k, np.int64) for k in self.kids]

    def best(self, asked: np.ndarray, own: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int):
        """The best ``k`` of ``found`` (scores, doc_ids, doc_id is null) and of the tree.

        ``asked`` are the item's terms, ``own`` their weights among all terms.
        """
        bound = self.most[:, asked].sum(axis=1)
        score, doc, void = found
        floor = max(int(score[-1]), 1) if len(score) >= k else 1
        stack = [0]
        while stack:
            node = stack.pop()
            if bound[node] < floor:
                continue
            if len(kids := self.kids[node]):
                kids = kids[bound[kids] >= floor]
                stack.extend(kids[np.argsort(bound[kids], kind="stable")].tolist())
                continue
            lo, hi = self.lo[node], self.hi[node]
            a, b = self.ptr[lo], self.ptr[hi]
            now = np.add.reduceat(own[self.rank[a:b]] * self.gain[a:b], self.ptr[lo:hi] - a)
            hit = np.flatnonzero(now >= floor)
            if len(hit):
                score = np.concatenate([score, now[hit]])
                doc = np.concatenate([doc, self.doc["id"][lo + hit]])
                void = np.concatenate([void, self.doc["void"][lo + hit]])
                first = np.lexsort((doc, void, -score))[:k]
                score, doc, void = score[first], doc[first], void[first]
                floor = max(int(score[-1]), 1) if len(score) >= k else 1
        return score, doc, void


def _search(items: list[tuple[int | None, np.ndarray]], place: np.ndarray, weight: np.ndarray, docs: int, length: int, k: int):
    """``place`` gives each term its place by frequency, ``weight`` the weight at each place."""

    def trees(batches):
        parts, entries, limit = [], 0, min(SHARD_ENTRIES, max(1, CELLS // len(weight)) * PAGE * 8)
        for batch in batches:
            parts.append(batch)
            entries += len(batch.column("terms").flatten())
            if entries >= limit:
                yield tree_of(parts)
                parts, entries = [], 0
        if entries:
            yield tree_of(parts)

    def tree_of(parts) -> Tree:
        whole = pa.Table.from_batches(parts).combine_chunks()
        ids = whole["doc_id"]
        kind = np.dtype([("id", np.int64), ("void", bool)])
        doc = np.zeros(len(whole), kind)
        doc["id"] = pc.fill_null(ids, 0).to_numpy()
        doc["void"] = pc.is_null(ids).to_numpy()
        size = pc.list_value_length(whole["terms"]).to_numpy().astype(np.int64)
        rank = place[pc.list_flatten(whole["terms"]).to_numpy()]
        tf = pc.list_flatten(whole["tfs"]).to_numpy().astype(np.int64)
        order = np.lexsort((rank, np.repeat(np.arange(len(size)), size)))
        m = 10 + (90 * docs * whole["n"].to_numpy()) // length
        return Tree(rank[order], tf[order], np.concatenate([[0], np.cumsum(size)]), m, doc, weight)

    def run(batches):
        none = np.zeros(0, np.int64)
        found = [(none, none, np.zeros(0, bool))] * len(items)
        own = np.zeros(len(weight), np.int64)
        for tree in trees(batches):
            for j, (_, asked) in enumerate(items):
                own[asked] = weight[asked]
                found[j] = tree.best(asked, own, found[j], k)
                own[asked] = 0
        name = pa.array([item for (item, _), f in zip(items, found) for _ in f[0]], pa.int64())
        score, doc, void = (np.concatenate([f[c] for f in found]) for c in range(3))
        yield pa.RecordBatch.from_arrays([name, pa.array(score), pa.array(doc, mask=void)], ["item_id", "score", "doc_id"])

    return run


def _search_block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame | None:
    """Candidates of one block of items: the best ``k`` of every task."""
    rows = pairs.select("item_id", "term").toPandas()
    vocabulary = sorted({bytes(t) for t in rows["term"]})
    if not vocabulary:
        return None
    vectors = docs.mapInArrow(_restrict(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>")
    vectors = materialise(vectors.where("n > 0"), "term_vectors")
    total = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
    if not total["docs"]:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[row["term"]] = row["count"]
    common = np.argsort(-df, kind="stable")  # most frequent first
    place = np.empty(len(vocabulary), np.int64)
    place[common] = np.arange(len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(n) + 1))) for n in df[common]], np.int64)
    at = {t: place[i] for i, t in enumerate(vocabulary)}
    items: dict = {}
    for item, void, term in zip(rows["item_id"], rows["item_id"].isna(), rows["term"]):
        items.setdefault(None if void else int(item), set()).add(int(at[bytes(term)]))
    asked = [(item, np.array(sorted(terms), np.int64)) for item, terms in items.items()]
    run = _search(asked, place, weight, int(total["docs"]), int(total["length"]), k)
    return vectors.where("size(terms) > 0").select("doc_id", "n", "terms", "tfs").mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    pairs = materialise(asked.mapInArrow(_item_terms, "item_id long, term binary").distinct(), "item_terms")
    blocks = max(1, math.ceil(pairs.count() / BLOCK_TERMS))
    found = items.sparkSession.createDataFrame([], FOUND)
    for block in range(blocks):
        part = _search_block(texts, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block), k)
        found = found if part is None else found.unionByName(part)
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("part", F.spark_partition_id() % 64)
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*best))).where(F.col("rank") <= k)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")
