"""Exact removal of repeated byte strings with merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or the same
document further left).  Strings that start one byte apart share an anchor, the smallest gram of ``GRAM``
bytes in them; equal strings have equal anchors.  So each text is cut into runs of strings with one anchor.

1. Runs are brought together by anchor.  Equal runs are settled by their hash: all but the first go.
   Each task first settles the runs it holds twice, so that a passage of very many documents is sent once
   per task.  Anchors that occur once, the bulk of a corpus, end here.
2. Anchors with several different runs (borders of passages, edited copies) need the bytes.  Their texts
   form pages of bounded size.  A page is dealt to shards; the shard's transform is made from its suffix
   array, and the transforms are merged by refining their interleave ``STEP`` symbols per round.  The rounds
   also give the common prefixes: after ``LENGTH`` symbols a block of the interleave is one repeated
   string, and its first place is known.  Suffixes of different shards are never sorted again.
3. The runs of an anchor of more runs than a page are cut again by anchors of more bytes, as in 1., until
   every anchor fits a page; an anchor of ``LENGTH`` bytes has one run, so the last cut leaves none.

Runs are compared by 64-bit hashes.

Defined cases: a null or empty text loses nothing; texts shorter than ``LENGTH`` lose nothing; repeated
rows of one doc_id count as one document and get equal results, so neither loses the other's text; rows with a null
doc_id take no part and lose nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import text as tx
from chronoweave.storage import materialise

LENGTH, GRAM = 100, 24
LONGER = (62, 86, LENGTH)  # bytes of the anchors that cut the runs of a frequent one
PAGE, SHARDS = 512, 4
STEP = 5  # symbols of a round; divides LENGTH
END = 0xFF  # ends a text in a transform; never a byte of UTF-8
MEMBERS = 1 << 20

RUNS = "gram long, run long, doc_id long, start long, n long, page long"
BODIES = RUNS + ", body binary"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < width:
        values = np.minimum(values[: len(values) - (width - have)], values[width - have :])
    return values


def anchored_runs(data: np.ndarray, offsets: np.ndarray, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor of ``size`` bytes: (gram hash, run hash, row, first start in the text, strings)."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    running = tx.prefix_hash(data)
    places = np.arange(len(data) - size + 1)
    grams = tx.span_hash(running, places, places + size)
    low = np.uint64((1 << 31) - 1)
    # A gram's rank is its hash, ties go left; which gram wins depends on the string's bytes alone.
    least = _sliding_min((grams & ~low) | places.astype(np.uint64), LENGTH - size + 1)
    anchor = (least & low).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(starts):
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    at = anchor[starts]
    row = np.searchsorted(offsets, starts, "right") - 1
    new = np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    whole = tx.span_hash(running, begin, begin + n + LENGTH - 1)
    return grams[at[first]], whole, row[first], begin - offsets[row[first]], n


def _rows(gram, run, doc, start, n, page) -> pa.RecordBatch:
    cols = [np.ascontiguousarray(c).view(np.int64) for c in (gram, run, doc, start, n, page)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in RUNS.split(", ")])


def _run_batches(batches):
    """Runs of a task's texts; page 0: to be compared, page -1: settled, an equal run of this task is first."""
    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        ids, parts = np.asarray(batch.column("doc_id"), np.int64), []
        for lo, _, data, offsets in tx.slices(batch.column("text")):
            gram, run, row, start, n = anchored_runs(data, offsets)
            parts.append((gram, run, ids[lo + row], start, n))
        if not parts:
            continue
        gram, run, doc, start, n = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((start, doc, run))
        gram, run, doc, start, n = (c[order] for c in (gram, run, doc, start, n))
        same = np.append(False, run[1:] == run[:-1])
        once = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])) | ~same  # not the same row again
        first = np.flatnonzero(~same)[np.cumsum(~same) - 1] if len(same) else same
        own = (doc == doc[first]) & (start == start[first])
        keep = ~same
        gone = same & once & ~own
        yield _rows(gram[keep], run[keep], doc[keep], start[keep], n[keep], np.zeros(keep.sum(), np.int64))
        if gone.any():  # the gram of a settled run only says where the row travels
            yield _rows(tx.mix(run[gone] + doc[gone].view(np.uint64) * np.uint64(2) + start[gone].view(np.uint64)), run[gone], doc[gone], start[gone], n[gone], np.full(gone.sum(), -1))


def _paged(batch: pa.RecordBatch, at: np.ndarray, page: np.ndarray) -> pa.RecordBatch:
    """Rows of a batch with their pages."""
    rows = batch.take(pa.array(at))
    return rows.set_column(rows.schema.get_field_index("page"), "page", pa.array(np.asarray(page, np.int64)))


def _settle_batches(batches):
    """Runs sorted by (gram, run, doc_id, start): settled rows pass, single grams end, equal runs are settled.

    Out: page -1 for runs that go; page 0, 1, ... for the first of each of several runs of a gram.
    """
    held = None  # first run of a gram of which no second run has come
    last_gram = last_run = last_doc = last_start = None
    opened = 0
    for batch in batches:
        done = np.asarray(batch.column("page")) < 0
        if done.any():
            yield batch.filter(pa.array(done))
            batch = batch.filter(pa.array(~done))
        gram, run, doc, start = (np.asarray(batch.column(c)) for c in ("gram", "run", "doc_id", "start"))
        if not len(gram):
            continue
        same_gram = np.append(gram[0] == last_gram if last_gram is not None else False, gram[1:] == gram[:-1])
        same_run = same_gram & np.append(run[0] == last_run if last_run is not None else False, run[1:] == run[:-1])
        same_row = same_run & np.append(doc[0] == last_doc and start[0] == last_start, (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]))
        gone = np.flatnonzero(same_run & ~same_row)
        firsts = np.flatnonzero(~same_run)
        # Ordinal of each run within its gram; runs of the gram left open by the last batch count on.
        ordinal = np.zeros(len(firsts), np.int64)
        if len(firsts):
            head = ~same_gram[firsts]
            base = np.maximum.accumulate(np.where(head, np.arange(len(firsts)), -1))
            ordinal = np.where(base >= 0, np.arange(len(firsts)) - base, opened + np.arange(len(firsts)))
            follows = np.append(~head[1:], False)  # another run of the gram comes later in this batch
            if not head[0] and held is not None:
                yield held
                held = None
            out = (ordinal > 0) | follows
            if out.any():
                yield _paged(batch, firsts[out], ordinal[out] // PAGE)
            opened = int(ordinal[-1]) + 1
            held = _paged(batch, firsts[-1:], [0]) if ordinal[-1] == 0 else None
        if len(gone):
            yield _paged(batch, gone, np.full(len(gone), -1))
        last_gram, last_run, last_doc, last_start = gram[-1], run[-1], doc[-1], start[-1]


def _finer_batches(size: int):
    """Runs with their bytes cut again by anchors of ``size`` bytes."""

    def run(batches):
        for batch in batches:
            doc, begin = np.asarray(batch.column("doc_id")), np.asarray(batch.column("start"))
            for lo, _, data, offsets in tx.slices(batch.column("body")):
                gram, whole, row, start, n = anchored_runs(data, offsets, size)
                at, lengths = offsets[row] + start, n + LENGTH - 1
                edges = np.append(0, np.cumsum(lengths))
                body = data[np.repeat(at - edges[:-1], lengths) + np.arange(edges[-1])]
                bodies = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(body)])
                rows = _rows(gram, whole, doc[lo + row], begin[lo + row] + start, n, np.zeros(len(n), np.int64))
                yield rows.append_column("body", bodies)

    return run


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Order of all suffixes of texts that each end with ``END``, up to ``LENGTH`` bytes or the end of a text.

    Ranks of 8 bytes are doubled until they cover ``LENGTH``; what follows an end does not count.
    """
    n = len(data)
    ends = np.flatnonzero(data == END)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # bytes before the end of the text
    padded = np.append(data, np.full(8, END, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(j <= left, padded[j : n + j], np.uint64(END))
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    width = 8
    while width < LENGTH:
        beyond = np.zeros(n, np.uint64)
        beyond[: n - width] = np.where(left[: n - width] >= width, rank[width:] + np.uint64(1), np.uint64(0))
        key = (rank << np.uint64(32)) | beyond
        width *= 2
        if width < LENGTH:
            rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    return np.argsort(key, kind="stable")


def transform(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The ``STEP`` symbols before each suffix in sorted order, the first one highest; before a text's start
    stands its own end, and what follows an end does not count."""
    ends = np.flatnonzero(data == END)
    sizes = np.diff(ends, prepend=-1)
    begin, ring = np.repeat(ends - sizes + 1, sizes), np.repeat(sizes, sizes)
    inside = np.arange(len(data)) - begin
    code, ended = np.zeros(len(data), np.uint64), np.zeros(len(data), bool)
    for j in range(STEP, 0, -1):
        symbol = data[begin + (inside - j) % ring]
        code = (code << np.uint64(8)) | np.where(ended, 0, symbol).astype(np.uint64)
        ended |= symbol == END
    return code[order]


def merge(transforms: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of several transforms and the blocks of suffixes that share ``length`` symbols, a
    multiple of ``STEP``.

    Every round refines the interleave by ``STEP`` symbols: the merged transform is read in the present order
    and its entries are dealt, stably, by symbols.  A block splits where the symbols or the old block change,
    and what has reached its text's end is a block of its own.
    """
    codes, rank = np.unique(np.concatenate(transforms), return_inverse=True)
    joined = rank.astype(np.uint16 if len(codes) <= 1 << 16 else np.uint32)
    ended = np.zeros(len(codes), bool)
    for j in range(STEP):
        ended |= (codes >> np.uint64(8 * j)) & np.uint64(255) == END
    dealt = np.sort(joined)  # the symbols in dealt order, the same in every round
    split = np.append(True, dealt[1:] != dealt[:-1]) | ended[dealt]
    weave = np.repeat(np.arange(len(transforms), dtype=np.int8), [len(t) for t in transforms])
    block = np.zeros(len(joined), np.int32)
    symbols = np.empty_like(joined)
    for _ in range(length // STEP):
        symbols[np.argsort(weave, kind="stable")] = joined
        deal = np.argsort(symbols, kind="stable")
        old = block[deal]
        new = split.copy()
        new[1:] |= old[1:] != old[:-1]
        weave = weave[deal]
        block = np.cumsum(new, dtype=np.int32) - 1
    return weave, block


def settle_page(texts: list[np.ndarray], doc: np.ndarray, start: np.ndarray, n: np.ndarray):
    """Strings of a page: (text, offset, whether the string also starts earlier)."""
    shards = [range(s, len(texts), SHARDS) for s in range(min(SHARDS, len(texts)))]
    parts, places = [], []
    for shard in shards:
        data = np.concatenate([np.append(texts[i], np.uint8(END)) for i in shard])
        order = suffix_array(data)
        parts.append(transform(data, order))
        owner = np.repeat(np.array(shard), [len(texts[i]) + 1 for i in shard])
        offset = np.concatenate([np.arange(len(texts[i]) + 1) for i in shard])
        places.append((owner[order], offset[order]))
    weave, block = merge(parts)
    back = np.argsort(weave, kind="stable")
    owner, offset = np.empty(len(weave), np.int64), np.empty(len(weave), np.int64)
    owner[back] = np.concatenate([p[0] for p in places])
    offset[back] = np.concatenate([p[1] for p in places])
    mine = offset < n[owner]  # the strings that the run stands for
    owner, offset, block = owner[mine], offset[mine], block[mine]
    at = start[owner] + offset
    order = np.lexsort((at, doc[owner], block))
    owner, offset, block, at = owner[order], offset[order], block[order], at[order]
    first = np.append(True, block[1:] != block[:-1])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    return owner, offset, (doc[owner] != doc[owner][head]) | (at != at[head])


GONE = "doc_id long, start long, n long"


def _page_batches(batches):
    """Pages of runs with their bytes, the runs of an anchor never apart; out: runs of strings that go."""

    def settle(rows):
        _, doc, start, n, body = zip(*rows)
        texts = [np.frombuffer(b, np.uint8) for b in body]
        doc, start, n = np.array(doc), np.array(start), np.array(n)
        owner, offset, gone = settle_page(texts, doc, start, n)
        order = np.lexsort((offset[gone], owner[gone]))
        o, k = owner[gone][order], offset[gone][order]
        lead = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (k[1:] != k[:-1] + 1))[: len(o)])
        size = np.diff(np.append(lead, len(o)))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (doc[o[lead]], start[o[lead]] + k[lead], size)], [c.split()[0] for c in GONE.split(", ")])

    held = []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("gram", "doc_id", "start", "n", "body")]
        for row in zip(*cols):
            if len(held) >= PAGE and held[-1][0] != row[0]:
                yield settle(held)
                held = []
            held.append(row)
    if held:
        yield settle(held)


def _pick_batches(slots: np.ndarray):
    wanted = np.zeros(MEMBERS, bool)
    wanted[slots] = True

    def run(batches):
        for batch in batches:
            known = np.asarray(batch.column("doc_id").fill_null(0)).view(np.uint64)
            yield batch.filter(pa.array(wanted[(tx.mix(known) & np.uint64(MEMBERS - 1)).astype(np.int64)]))

    return run


def _slots_of(batches):
    for batch in batches:
        slot = np.unique(tx.mix(np.asarray(batch.column("doc_id")).view(np.uint64)) & np.uint64(MEMBERS - 1))
        yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64))], ["slot"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, n: runs of strings that also start earlier; they may overlap."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = body.mapInArrow(_run_batches, RUNS).repartition(n, "gram").sortWithinPartitions("gram", "run", "doc_id", "start")
    settled = materialise(runs.mapInArrow(_settle_batches, RUNS), "runs")
    gone = settled.where("page < 0").select("doc_id", "start", "n")
    open_ = settled.where("page >= 0")
    slots = np.array([r[0] for r in open_.select("doc_id").mapInArrow(_slots_of, "slot long").distinct().collect()], np.int64)  # at most MEMBERS
    if not len(slots):
        return gone
    asked = open_.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "run", "start", "n", "page")).alias("runs"))
    texts = body.mapInArrow(_pick_batches(slots), "doc_id long, text string").dropDuplicates(["doc_id"])
    cut = texts.select("doc_id", F.col("text").cast("binary").alias("raw")).join(asked, "doc_id").select("doc_id", "raw", F.inline("runs"))
    runs = cut.select("gram", "run", "doc_id", "start", "n", "page", F.expr(f"substring(raw, int(start) + 1, int(n) + {LENGTH - 1})").alias("body"))
    runs, paged = materialise(runs, "bodies"), None
    for size in LONGER:  # frequent anchors are cut by longer ones
        hot = runs.where("page > 0").select("gram").distinct()
        cold = runs.join(hot, "gram", "left_anti")
        paged = cold if paged is None else paged.unionByName(cold)
        if hot.isEmpty():
            break
        finer = runs.join(hot, "gram", "left_semi").select("body", "doc_id", "start").mapInArrow(_finer_batches(size), BODIES)
        finer = finer.repartition(n, "gram").sortWithinPartitions("gram", "run", "doc_id", "start")
        settled = materialise(finer.mapInArrow(_settle_batches, BODIES), "finer_runs")
        gone = gone.unionByName(settled.where("page < 0").select("doc_id", "start", "n"))
        runs = settled.where("page >= 0")
    pages = paged.select("gram", "doc_id", "start", "n", "body").repartition(n, "gram").sortWithinPartitions("gram")
    return gone.unionByName(pages.mapInArrow(_page_batches, GONE))


def _spans(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte spans covered by runs of strings."""
    order = np.argsort(starts, kind="stable")
    lo, hi = starts[order], np.maximum.accumulate((starts + counts + LENGTH - 1)[order])
    first = np.append(True, lo[1:] > hi[:-1])
    return lo[first], np.append(hi[:-1][first[1:]], hi[-1])


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _remove_batches(with_text: bool):
    def run(batches):
        for batch in batches:
            rows, kept_text = [], []
            starts, counts = batch.column("starts"), batch.column("counts")
            for _lo, hi, data, offsets in tx.slices(batch.column("text")):
                for row in range(_lo, hi):
                    raw = data[offsets[row - _lo] : offsets[row - _lo + 1]]
                    removed = spans = 0
                    kept = raw
                    if starts[row].is_valid and len(starts[row]):
                        lo, up = _spans(np.asarray(starts[row].values), np.asarray(counts[row].values))
                        mask = np.zeros(len(raw) + 1, np.int64)
                        mask[lo] += 1
                        mask[up] -= 1
                        kept = raw[np.cumsum(mask[:-1]) == 0]
                        removed, spans = len(raw) - len(kept), len(lo)
                    rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
                    kept_text.append(kept.tobytes().decode(errors="ignore") if with_text else None)
            cols = list(zip(*rows)) or [()] * 4
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, pa.array(kept_text, pa.string())], [c.split()[0] for c in REMOVED.split(", ")])

    return run


def remove(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Counts, digest and text of what is left of every document.  In the text column bytes that no longer
    form a character are left out; the digest is of all bytes left."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = materialise(repeated_runs(body).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts")), "gone")
    return body.join(runs, "doc_id", "left").mapInArrow(_remove_batches(with_text), REMOVED)
