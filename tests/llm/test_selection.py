from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import ann, mixing, pii, quality
from tests.llm.helpers import ODD, frame, prose, words


def test_budget_is_met_by_whole_documents():
    rng = np.random.default_rng(1)
    for budget in (0, 1, 17, 5_000, 123_456, 10**7):
        lengths = np.unique(rng.integers(1, 900, 200))
        counts = rng.integers(1, 40, len(lengths))
        take = mixing.fit_budget(lengths, counts, budget)
        assert ((0 <= take) & (take <= counts)).all()
        total = int((lengths * take).sum())
        assert total == min(budget, int((lengths * counts).sum())) or budget - total < lengths.min()


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), f"src{i % 5}" if i % 6 else None) for i in range(400)]
    rows += [(1000 + i, "same length text", "hot") for i in range(700)] + [(i, t, "odd") for i, t in ODD]
    got = mixing.mix(frame(spark, rows), (3.0, 1.0, 2.0), 1.5).toPandas()
    again = mixing.mix(frame(spark, rows), (3.0, 1.0, 2.0), 1.5).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None), key=str) + [None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        free -= over
    got["source"] = got["source"].where(got["source"].notna(), None)
    for source in order:
        part = got[got["source"].isna()] if source is None else got[got["source"] == source]
        assert part["source_size"].unique().tolist() == [size[source]]
        assert part["target"].iloc[0] == pytest.approx(target[source])
        assert 0 <= target[source] - part["taken"].sum() < 24
    assert mixing.mix(frame(spark, [])).count() == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    def fits(kind, said):
        digits = re.sub(r"[^0-9]", "", said)
        return {
            "email": True,
            "ip": all(int(p) <= 255 for p in said.split(".")) if kind == "ip" else False,
            "card": 13 <= len(digits) <= 19 and luhn(digits),
            "phone": 9 <= len(digits) <= 15,
        }[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS for m in re.finditer(p, text) if fits(k, m[0])]


PERSONAL = [
    "write a@b.com_foo@x.y or é%@q-r.s.t. now @x.y a@b a@@b.c x@y.z@w.v",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 001.2.3.255.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500000000000004 12",
    "+1 (555) 123-4567 +12 ( +44.20.7946.0958+1-1",
    "".join("+1(" for _ in range(50)) + "a" * 3000 + "@",
]


def test_base_spans_equal_the_patterns(spark):
    rng = np.random.default_rng(2)
    noise = ["".join(rng.choice(list("a.@-+ 0123456789()_é"), 60)) for _ in range(400)]
    rows = list(enumerate(PERSONAL + noise)) + ODD
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    for i, t in rows:
        assert got[i].base == ",".join(plain_spans(t or ""))


def test_terms_that_reveal_a_value(spark):
    rows = [(i, f"{prose(i, 20)} Reach Zebulonia at zeb@corp.example {prose(900 + i, 20)}") for i in range(6)]
    rows += [(10 + i, f"{prose(50 + i, 30)} reach someone else {prose(70 + i, 5)}") for i in range(60)]
    rows += [(100, "Only Zebulonia here, no address"), (101, None), (100, "Only Zebulonia here, no address")]
    rows += [(200 + i, "copied Copyterm near c@d.ef text") for i in range(9)]
    got = {r.doc_id: r.spans for r in pii.find(frame(spark, rows)).collect()}
    assert "term:5:14" in got[100] or "gone:5:14" in got[100]
    assert all("term" not in got[i] and "gone" not in got[i] for i in range(10, 70)) and "term" not in got[200]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "Zebulonia" not in clean[100] and "zeb@" not in clean[3] and "<EMAIL>" in clean[3]
    assert clean[15] == dict(rows)[15] and clean[101] is None
    assert pii.find(frame(spark, [])).count() == pii.sanitise(frame(spark, [])).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, rank int"


def test_nearest_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 20)).astype(np.float32)
    x[300:340] = x[10]
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0, 0), (2001, [0.0] * 20, 0, 0), (2002, [float("nan")] * 20, 0, 0), (2003, [None] * 20, 0, 0), (2004, [1.0], 0, 0), (None, x[0].tolist(), 0, 0)]
    got = ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, 5).toPandas()
    wide = x.astype(float)
    hits = 0
    for q, part in got.groupby("query_id"):
        score = ann.cosine(wide, wide[q])
        best = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:5]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == [1, 2, 3, 4, 5] and part["score"].tolist() == score[part["vec_id"]].tolist()
        hits += len(set(best) & set(part["vec_id"]))
    assert got["query_id"].nunique() == 90 and hits >= 0.9 * 450
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert ann.search(few, F.col("vec_id") == 0, 5).count() == 2
    empty = spark.createDataFrame([], VECTORS)
    assert ann.search(empty, F.col("vec_id") == 0, 5).count() == 0


def test_vectors_of_several_lengths_and_of_any_size(spark):
    """Each length is a search of its own; components near the ends of the range of doubles count like others."""
    rng = np.random.default_rng(14)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=(30, 5))
    scale = 10.0 ** rng.integers(-220, 220, (40, 1))
    kind = "vec_id long, embedding array<double>, block int, dim int"
    rows = [(i, (v * s).tolist(), 0, 0) for i, (v, s) in enumerate(zip(x, scale[:, 0]))] + [(100 + i, v.tolist(), 0, 0) for i, v in enumerate(y)]
    rows += [(500, [1.0, 2.0, 3.0], 0, 0), (501, [], 0, 0), (502, [1e300, float("inf")], 0, 0), (503, [5e-324, 0.0], 0, 0)]
    got = ann.search(spark.createDataFrame(rows, kind), F.col("vec_id") % 10 == 0, 5).toPandas()
    assert set(got["query_id"]) == {*range(0, 40, 10), *range(100, 130, 10)}  # 500 is alone with its length
    assert np.isfinite(got["score"]).all()
    sides = [(np.append(np.arange(40), 503), np.vstack([x, [[1.0, 0.0]]])), (np.arange(100, 130), y)]
    for q, part in got.groupby("query_id"):
        ids, wide = sides[int(q >= 100)]
        score = dict(zip(ids.tolist(), ann.cosine(wide, wide[ids == q][0])))
        want = sorted((i for i in score if i != q), key=lambda i: -score[i])[:5]
        part = part.sort_values("rank")
        assert part["vec_id"].tolist() == want
        assert part["score"].tolist() == pytest.approx([score[i] for i in want], abs=1e-12)


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(20, 64))
    turn = ann.rotation(64, 5)
    guess, width = ann.estimate(*ann.encode(x, turn), q, turn)
    true = np.stack([ann.cosine(x, v) for v in q])
    assert (np.abs(guess - true) <= width).mean() > 0.97


def plain_counts(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_statistics_and_verdicts(spark):
    good = [(i, prose(i, 60 + i % 50)) for i in range(300)]
    bad = [(400 + i, prose(600 + i, 60).replace(" ", "%%% ")) for i in range(30)]
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: "b", 98: "a"})
    other = word.translate({97: "b", 98: "a"})  # no sum modulo a power of two tells these apart
    odd = [(500, "a b c d e f g h " * 6), (501, "line one here\nline one here\n\n\nx\nx"), (502, f"{word}\n{other}"), *ODD]
    docs = frame(spark, good + bad + odd)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(400 + i, 0, 0) for i in range(12)] + [(9999, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    for i, t in good + bad + odd:
        counts = plain_counts(t)
        row = got[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts
        assert row.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (row.base_failed and row.kept)
    assert sum(got[i].kept for i, _ in good) >= 295 and sum(got[i].kept for i, _ in bad) <= 15
    none = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality.judge(frame(spark, []), labels).count() == 0


def test_column_views_of_sliced_arrays():
    whole = pa.array(["aa", None, "b c", "d"])
    from chronoweave.llm import text as tx

    data, offsets = tx.buffers(whole.slice(1, 2))
    assert data.tobytes() == b"b c" and offsets.tolist() == [0, 0, 3]


def test_stages_keep_odd_rows_and_clashing_names(spark):
    rows = [(i, prose(i, 40) + (f" me{i}@corp.example" if i % 3 == 0 else ""), f"s{i % 3}") for i in range(60)]
    rows += [(None, prose(99, 40), "s1"), (None, prose(98, 40), None), (5, prose(97, 40), "s2"), (70, None, "s0"), (71, "", None), (72, prose(96, 30000), "s0")]
    docs = frame(spark, rows)
    for name, new in {"h": "_id", "bucket": "__words", "rank": "_spans"}.items():
        docs = docs.withColumnRenamed(name, new)
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    verdicts = quality.judge(docs, labels).where("kept").select("doc_id")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in verdicts.collect())
    assert kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 5").count() == 2
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert clean.where("text like '%@corp%'").count() == 0 and clean.where("doc_id is null").count() == 2
    mixed = mixing.repeat(docs)
    assert mixed.columns == docs.columns
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert max(times.values()) <= 2 and not {(70, None), (71, "")} & set(times)
    taken, whole = Counter(), Counter()
    for i, text, source in rows:
        whole[source] += len(words(text))
        taken[source] += times[i, text] * len(words(text))
    same = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert {r.source: r.taken for r in same} == taken and all(r.taken <= r.target <= 2 * whole[r.source] for r in same)
    assert sum(times.values()) == mixing.repeat(docs).count()
    none = docs.limit(0)
    assert quality.keep(none, labels).count() == pii.sanitise(none).count() == mixing.repeat(none).count() == 0
