from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from chronoweave.llm import ranked
from tests.llm.helpers import ODD, frame, prose

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEMS = "item_id long, text string, doc_id long, score long, rank int"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    held = [(doc, Counter(terms(text))) for doc, text in docs if terms(text)]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            scored.append((-score, doc is None, doc or 0, doc, score))
        best = sorted((s for s in scored if s[4] > 0), key=lambda s: s[:3])[:k]
        out += [(item, i + 1, s[3], s[4]) for i, s in enumerate(best)]
    return sorted(out, key=repr)


def searched(spark, docs, items):
    rows = [(i, t, 5, 6, 7) for i, t in items]
    got = ranked.search(frame(spark, docs), spark.createDataFrame(rows, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def corpus(seed):
    rng = random.Random(seed)
    few = [f"w{i}" for i in range(60)] + ["Ärger", "ñandú", "X9"]
    docs = [(i, " ".join(few[min(int(rng.expovariate(0.12)), 62)] for _ in range(rng.randint(1, 40)))) for i in range(600)]
    docs += [(1000 + i, "one same text w1 w2 w3 w50") for i in range(300)]
    docs += [(2000 + i, prose(i, 30)) for i in range(20)] + [(5, "w1 w2 w40"), (None, "w1 w40 w41"), (3000, "w41 " * 30_000)] + ODD
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.randint(1, 12)))) for i in range(30)]
    items += [(100, "SAME text, w50!"), (101, None), (102, "..."), (103, "nobody has this"), (104, "w1"), (104, "W2"), (None, "x9 W41"), (105, prose(3, 30))]
    return docs, items


def test_ranked_search_equals_scoring_everything(spark):
    docs, items = corpus(1)
    assert searched(spark, docs, items) == plain(docs, items)
    assert searched(spark, docs[:4], items) == plain(docs[:4], items)


def test_small_trees_and_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(2)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 20)
    assert searched(spark, docs, items) == plain(docs, items)


def test_a_tree_finds_what_its_vectors_hold():
    rng = np.random.default_rng(3)
    vectors = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)) for _ in range(900)] + [np.array([0, 1, 2])] * 200
    rank, ptr = np.concatenate(vectors), np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    tf, m = rng.integers(1, 9, len(rank)), rng.integers(10, 300, len(vectors))
    doc = np.zeros(len(vectors), [("id", np.int64), ("void", bool)])
    doc["id"] = rng.permutation(len(vectors))
    weight = rng.integers(0, 5000, 40)
    tree = ranked.Tree(rank, tf, ptr, m, doc, weight)
    assert len(tree.lo) > 20 and max(tree.hi[i] - tree.lo[i] for i in range(len(tree.lo)) if not len(tree.kids[i])) >= 200
    for _ in range(50):
        asked = np.sort(rng.choice(40, 6, replace=False))
        own = np.zeros(40, np.int64)
        own[asked] = weight[asked]
        none = np.zeros(0, np.int64)
        score, found, _ = tree.best(asked, own, (none, none, np.zeros(0, bool)), 10)
        whole = np.add.reduceat(own[rank] * ranked.gain(tf, np.repeat(m, np.diff(ptr))), ptr[:-1])
        first = np.lexsort((doc["id"], -whole))[:10]
        first = first[whole[first] > 0]
        assert score.tolist() == whole[first].tolist() and found.tolist() == doc["id"][first].tolist()


def test_empty_tables(spark):
    docs, items = corpus(4)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == [] and searched(spark, [(1, None), (2, ",")], items) == []
