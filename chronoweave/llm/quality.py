"""Quality rules: rule statistics of every document and an isolation forest over them.

``statistics`` reads the texts once.  ``fit`` grows the forest from at most ``FIT_ROWS`` labelled rows,
taken by a seeded hash; its size is fixed.  ``threshold`` looks at the scores of all labelled rows
through a histogram of fixed size.  ``judge`` gives every document its verdict, ``keep`` the rows of the
documents that it keeps: the verdict is made again in the pass that copies a row, so no row moves.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows get equal
verdicts; without labelled rows only the base rules reject; labels of unknown documents are ignored;
rows with a null doc_id get a verdict like any other; an empty table gives an empty result; columns
besides ``doc_id`` and ``text`` are not looked at and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import text as tx
from chronoweave.storage import materialise

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
FIT_ROWS = 20_000  # bound of the sample that the forest is grown from
TREES, TREE_ROWS, DEPTH = 100, 256, 8
FALSE_REJECTS = 0.002  # share of labelled good rows that the threshold may reject
GOOD_WEIGHT = 20.0  # a share of good rows lost counts so many times a share of bad rows found
BINS = 2000
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long"

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row; keys of different rows differ."""
    _, first = np.unique(keys, return_index=True)
    return np.bincount(rows[first], minlength=n)


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The statistics of each text of a run of rows."""
    n = len(offsets) - 1
    starts, ends = tx.word_spans(data, offsets)
    n_words = tx.counts_between(starts, offsets)
    chars = tx.sums_between(~tx.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    symbols = tx.sums_between(SYMBOL[data], offsets)
    running = tx.prefix_hash(data)
    salt = tx.mix(np.arange(1, n + 1, dtype=np.uint64))

    words = tx.span_hash(running, starts, ends)
    row = np.repeat(np.arange(n), n_words)
    distinct = _distinct(tx.mix(words ^ salt[row]), row, n)

    repeat = np.zeros(n, np.int64)
    grams = tx.gram_hash(words, WINDOW)
    whole = row[: len(grams)] == row[WINDOW - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    if len(at):
        at = at[_repeated(tx.mix(grams[at] ^ salt[row[at]]))]
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + WINDOW, -1)
        repeat = np.bincount(row[np.cumsum(depth[:-1]) > 0], minlength=n)

    lines, stops = tx.line_spans(data, offsets)
    line_row = np.searchsorted(offsets[1:], lines, "right")
    line_row = np.minimum(line_row, n - 1)
    spoken = np.searchsorted(starts, stops) > np.searchsorted(starts, lines)
    lines, stops, line_row = lines[spoken], stops[spoken], line_row[spoken]
    keys = tx.mix(tx.span_hash(running, lines, stops) ^ salt[line_row])
    n_lines = np.bincount(line_row, minlength=n)
    return [n_words, chars, symbols, n_lines - _distinct(keys, line_row, n), repeat, n_lines, distinct]


COUNTS = [part.split()[0] for part in STATS.split(", ")][1:]


def _counts(column: pa.Array) -> list[np.ndarray]:
    parts = [rule_counts(data, offsets) for _, _, data, offsets in tx.slices(column)]
    return [np.concatenate(c).astype(np.int64) for c in zip(*parts)] or [np.zeros(0, np.int64)] * len(COUNTS)


def _count_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, _counts(batch.column("text")))], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """Rule statistics of every document, from its whole text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count_batches, STATS)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Word length, share and logarithm of symbols, and variety of words, a row for each text."""
    n = {name: np.asarray(values, float) for name, values in counts.items()}
    per = lambda a, b: np.divide(n[a], n[b], out=np.zeros(len(n[a])), where=n[b] > 0)
    variety = np.log1p(n["n_distinct"]) / np.log(2.0 + n["n_words"])
    return np.stack([per("word_chars", "n_words"), per("n_symbols", "n_words"), np.log1p(n["n_symbols"]), variety], 1)


@dataclass
class Forest:
    """Trees of fixed depth in heap order; ``feature`` -1 marks a leaf, ``path`` its path length."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row: near 1 for short paths, below 0.5 for usual rows."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                step = 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= cut[node])
                node = np.where(f >= 0, step, node)
            total += path[node]
        return 2.0 ** (-total / len(self.path) / self.norm)


def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    big = np.maximum(n, 2.0)
    return np.where(n > 1, 2 * (np.log(big - 1 + (n <= 2)) + 0.5772156649 * (n > 2)) - 2 * (big - 1) / big + (n <= 2) * 1.0, 0.0)


def grow(x: np.ndarray, seed: int) -> Forest:
    """Isolation forest: each tree splits a few rows at random cuts of random features."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (DEPTH + 1) - 1
    feature, cut, path = np.full((TREES, nodes), -1), np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
    take = min(TREE_ROWS, len(x))
    for t in range(TREES):
        held = {0: x[rng.choice(len(x), take, replace=False)]}
        for node in range(nodes):
            if (part := held.pop(node, None)) is None:
                continue
            depth = (node + 1).bit_length() - 1
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(x.shape[1]),) * 2
            split = np.flatnonzero(high > low)
            if depth == DEPTH or len(part) <= 1 or not len(split):
                path[t, node] = depth + _average_path(len(part))
                continue
            f = rng.choice(split)
            at = rng.uniform(low[f], high[f])
            feature[t, node], cut[t, node] = f, at
            held[2 * node + 1], held[2 * node + 2] = part[part[:, f] < at], part[part[:, f] >= at]
    return Forest(feature, cut, path, float(_average_path(max(take, 2))))


def _score_batches(forest: Forest):
    def run(batches):
        for batch in batches:
            x = features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x))], [*batch.schema.names, "score"])

    return run


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    kinds = ", ".join(f"{name} {kind}" for name, kind in stats.dtypes)
    return stats.mapInArrow(_score_batches(forest), f"{kinds}, score double")


def fit(stats: DataFrame, labels: DataFrame, seed: int = 7) -> Forest | None:
    """Forest grown from at most ``FIT_ROWS`` labelled documents that pass the base rules."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = stats.where(~base_failed()).join(known, "doc_id")
    order = F.xxhash64(F.lit(seed), "doc_id")
    sample = rows.select(*COUNTS, order.alias("h"), "doc_id").orderBy("h", "doc_id").limit(FIT_ROWS).toPandas()
    return grow(features({c: sample[c].to_numpy() for c in COUNTS}), seed) if len(sample) > 1 else None


def threshold(stats: DataFrame, labels: DataFrame, forest: Forest) -> float:
    """Score above which a document goes: it separates the labelled rows best among the scores that
    reject at most ``FALSE_REJECTS`` of the good ones."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()
    rows = scored(stats.where(~base_failed()).join(known, "doc_id"), forest)
    table = rows.groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("b"), "quality").count().toPandas()
    sides = np.zeros((2, BINS))
    for b, quality, n in table.itertuples(index=False):
        sides[int(quality), int(b)] += n
    above = np.concatenate([sides[:, ::-1].cumsum(1)[:, ::-1], np.zeros((2, 1))], 1)  # rows in bin b or later
    shares = above / np.maximum(sides.sum(1, keepdims=True), 1)
    allowed = shares[1] <= FALSE_REJECTS
    gain = np.where(allowed, shares[0] - GOOD_WEIGHT * shares[1], -1.0)
    return float(np.argmax(gain)) / BINS if gain.max() > 0 else 1.0


def judge(docs: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """Statistics, base verdict and final verdict of every document."""
    stats = materialise(statistics(docs), "rule_stats")
    forest = fit(stats, labels, seed)
    failed = F.coalesce(base_failed(), F.lit(True))
    if forest is None:
        return stats.withColumn("base_failed", failed).withColumn("score", F.lit(0.0)).withColumn("kept", ~failed)
    limit = threshold(stats, labels, forest)
    rows = scored(stats, forest).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") < limit))


def _keep_batches(forest: Forest | None, limit: float):
    def run(batches):
        for batch in batches:
            n = dict(zip(COUNTS, _counts(batch.column("text"))))
            kept = (n["n_words"] >= MIN_WORDS) & (100 * n["n_repeat_words"] <= REPEAT_PERCENT * n["n_words"])
            if forest is not None:
                kept &= forest.score(features(n)) < limit
            yield batch.filter(pa.array(kept))

    return run


def keep(docs: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps."""
    stats = materialise(statistics(docs), "rule_stats")
    forest = fit(stats, labels, seed)
    limit = threshold(stats, labels, forest) if forest is not None else 1.0
    return docs.mapInArrow(_keep_batches(forest, limit), docs.schema)
