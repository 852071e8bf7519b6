from __future__ import annotations

import hashlib
import pathlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from chronoweave.llm import graph, jaccard, paragraphs, substrings
from chronoweave.llm import text as tx
from chronoweave.storage import shared_dir
from tests.llm.helpers import ODD, components, edited, frame, prose, words


def grams(text, size):
    w = words(text, lower=True)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def linked(sets, num, den):
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and num * max(len(x), len(y)) <= den * min(len(x), len(y)):
                n = len(x & y)
                if den * n >= num * (len(x) + len(y) - n):
                    yield a, b


def test_components(spark):
    edges = [(i, i + 1) for i in range(60, 90)] + [(5, 5), (1, 9), (9, 4), (4, 1), (-3, 60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_against_all_pairs(spark):
    base = [prose(s, 90) for s in range(5)]
    rows = [(i, edited(base[i % 5], i, i % 11)) for i in range(230)]
    rows += [(300 + i, base[0]) for i in range(40)] + [(400 + i, prose(1000 + i, 30) + " " + base[1][:200]) for i in range(40)] + ODD
    rows += [(0, rows[0][1]), (500, "One two"), (501, "one TWO")]
    for size, share in ((4, (85, 100)), (5, (4, 5))):
        got = {r.doc_id: r for r in jaccard.join(frame(spark, rows), size, share).collect()}
        sets = {i: grams(t, size) for i, t in rows if i is not None}
        want = components(sets, linked(sets, *share))
        assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(sets[i]), want[i]) for i in sets}
        assert got[None].component_id is None


def test_join_of_a_group_over_several_pages(spark):
    """More near copies of one text than a page holds, some of them linked only through others."""
    base = prose(77, 60)
    rows = [(i, edited(base, i, i % 4)) for i in range(jaccard.PAGE + 300)]
    got = {r.doc_id: r.component_id for r in jaccard.join(frame(spark, rows), 5, (4, 5)).collect()}
    sets = {i: grams(t, 5) for i, t in rows}
    assert got == components(sets, linked(sets, 4, 5))


def test_a_pair_belongs_to_one_bucket():
    """Lists of buckets of any length: the smallest common one owns the pair; without one in sight, any may emit it."""
    rng = np.random.default_rng(5)
    lists = [sorted(rng.choice(60, rng.integers(1, 30), replace=False).tolist()) for _ in range(80)]
    rows = jaccard.named(pa.array([x[: jaccard.OWNERS] for x in lists], pa.list_(pa.int64())))
    for i, x in enumerate(lists):
        for j, y in enumerate(lists):
            shared = sorted(set(x) & set(y))
            emits = [b for b in shared if jaccard.owned(rows[[i]], rows[[j]], np.array([b]))[0]]
            seen = set(x[: jaccard.OWNERS]) & set(y[: jaccard.OWNERS])
            assert emits == (shared[:1] if seen else shared)


def test_pairs_of_a_round_are_few(spark, monkeypatch):
    """Near copies meet in very many buckets, but only one of them emits a pair."""
    emitted = []
    plain = jaccard.materialise

    def counted(rows, name):
        out = plain(rows, name)
        if name == "pairs":
            emitted.append(out.where("bucket is null").select("a", "b").collect())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    texts = [(i, edited(prose(i // 20, 120), i, 3 + i % 4)) for i in range(200)]
    got = {r.doc_id: r.component_id for r in jaccard.join(frame(spark, texts)).collect()}
    sets = {i: grams(t, 5) for i, t in texts}
    assert got == components(sets, linked(sets, 4, 5))
    for pairs in emitted:
        assert len(pairs) <= 1.5 * len(set(pairs))


def test_tree_finds_every_pair_within_the_bound():
    rng = np.random.default_rng(3)
    points = rng.poisson(2.0, (300, 16)).astype(np.int64)
    points[150:] = np.maximum(points[:150] + rng.integers(-1, 2, (150, 16)) * (rng.random((150, 16)) < 0.1), 0)
    sizes = points.sum(1)
    q, c, bound = jaccard.Tree(points, sizes).pairs(points, sizes, (4, 5))
    want = {(i, j) for i in range(300) for j in range(300) if 9 * np.minimum(points[i], points[j]).sum() >= 4 * (sizes[i] + sizes[j])}
    assert set(zip(q.tolist(), c.tolist())) == want


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard.join(none).count() == paragraphs.classes(none).count() == substrings.remove(none).count() == 0


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_bands_keep_the_recall(similarity):
    bands, rows = paragraphs.tune(similarity)
    assert bands * rows <= paragraphs.MAX_HASHES
    assert 1 - (1 - similarity**rows) ** bands >= paragraphs.RECALL


def test_paragraph_classes(spark):
    passage = [prose(s, 70).replace("\n", "") for s in range(4)]
    rows = [(i, f"{prose(100 + i, 25)}\n{edited(passage[i % 4], i, i % 3)}\n{prose(200 + i, 8)}") for i in range(80)]
    rows += [(200 + i, prose(300 + i, 60)) for i in range(30)] + ODD
    got = {(r.doc_id, r.place): r for r in paragraphs.classes(frame(spark, rows)).collect()}
    sets, spans = {}, {}
    for i, t in rows:
        raw = (t or "").encode()
        for _, place, lo, hi, _found in paragraphs._sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) if i is not None else ():
            sets[i, int(place)] = grams(raw[lo:hi].decode(), paragraphs.SIZE)
            spans[i, int(place)] = raw[lo:hi].decode()
    want = components(sets, linked(sets, *paragraphs.SHARE))
    sizes = {}
    for top in want.values():
        sizes[top] = sizes.get(top, 0) + 1
    assert set(got) == {k for k in sets if sizes[want[k]] > 1}
    text = {i: t for i, t in rows}
    for key, row in got.items():
        assert (row.class_doc_id, row.class_id % paragraphs.PLACES) == want[key]
        assert row.removed == (want[key] != key) and text[key[0]][row.start : row.end] == spans[key]
    left = {r.doc_id: r.text for r in paragraphs.remove(frame(spark, rows)).collect()}
    assert all(left[i] == t for i, t in rows if i is not None and i >= 200)
    assert sum(len(left[i]) < len(text[i]) for i in range(80)) > 40


def removal(rows):
    """Brute force over all strings in order."""
    seen, out = {}, {}
    for i, t in sorted((r for r in set(rows) if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - substrings.LENGTH + 1):
            piece = raw[s : s + substrings.LENGTH]
            if piece in seen:
                gone[s : s + substrings.LENGTH] = True
            seen.setdefault(piece, i)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings(spark, monkeypatch):
    base = [prose(s, 60) for s in range(6)]
    shared = prose(50, 45)
    rows = [(i, edited(base[i % 6], i, i % 5)) for i in range(60)]
    rows += [(100 + i, prose(400 + i, 20) + shared + prose(500 + i, 20)) for i in range(substrings.PAGE + 90)]
    rows += [(2000, "ab" * 400), (2001, "ab" * 90 + "é" * 120), (2002, "x" * 99), (2003, base[0]), (2004, base[0]), (2004, base[0]), *ODD]
    got = {r.doc_id: tuple(r)[1:5] for r in substrings.remove(frame(spark, rows)).collect()}
    want = removal(rows)
    assert {i: got[i] for i in want} == want
    assert got[None][1] == 0


def test_merged_transforms_equal_one_sort():
    rng = np.random.default_rng(9)
    texts = [np.frombuffer("".join(rng.choice(list("ab"), 130)).encode(), np.uint8) for _ in range(9)]
    parts, places = [], []
    for s in range(3):
        data = np.concatenate([np.append(t, np.uint8(substrings.END)) for t in texts[s::3]])
        order = substrings.suffix_array(data)
        parts.append(substrings.transform(data, order))
        owner = np.repeat(np.arange(s, 9, 3), 131)
        places.append([(int(o), int(k) % 131) for o, k in zip(owner[order], order)])
    weave, block = substrings.merge(parts, 20)
    take = [iter(p) for p in places]
    merged = [next(take[s]) for s in weave]
    heads = [texts[o][k : k + 20].tobytes() + bytes([255] if k + 20 > 130 else []) for o, k in merged]
    assert heads == sorted(heads)
    for i in range(1, len(merged)):
        full = merged[i][1] + 20 <= 130 and merged[i - 1][1] + 20 <= 130
        assert (block[i] == block[i - 1]) == (full and heads[i] == heads[i - 1])


def test_runs_of_a_frequent_anchor_are_cut_until_none_is_frequent():
    """Border runs of one passage in many texts: ever longer anchors hold fewer of them, in the end none."""
    shared = prose(50, 45).encode()
    texts = [prose(400 + i, 20).encode() + shared + prose(900 + i, 20).encode() for i in range(substrings.PAGE + 90)]
    data, edges = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    gram, run, row, start, n = substrings.anchored_runs(data, edges)

    def settle(rows):
        order = rows.sort_by([(c, "ascending") for c in ("gram", "run", "doc_id", "start")])
        return pa.Table.from_batches(substrings._settle_batches(order.to_batches(max_chunksize=700)), rows.schema)

    bodies = [texts[r][s : s + k + substrings.LENGTH - 1] for r, s, k in zip(row, start, n)]
    cols = [gram.view(np.int64), run.view(np.int64), row, start, n, np.zeros(len(n), np.int64), pa.array(bodies, pa.binary())]
    table = pa.Table.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in substrings.BODIES.split(", ")])
    left = settle(table)
    hot = [len(left.filter(pa.compute.greater(left["page"], 0)))]
    for size in substrings.LONGER:
        open_ = left.filter(pa.compute.greater_equal(left["page"], 0))
        finer = list(substrings._finer_batches(size)(open_.to_batches()))
        assert sum(pa.compute.sum(b["n"]).as_py() for b in finer) == pa.compute.sum(open_["n"]).as_py()
        for b in finer:
            for r, s, k, body in zip(*(b[c].to_pylist() for c in ("doc_id", "start", "n", "body"))):
                assert texts[r][s : s + k + substrings.LENGTH - 1] == body
        left = settle(pa.Table.from_batches(finer))
        hot.append(len(left.filter(pa.compute.greater(left["page"], 0))))
    assert hot[0] > 0 and not (left["page"].to_numpy() >= 0).any()


def test_words_and_lines_of_texts():
    texts = ["", " a\tbc\n", "é\n\nx", "\n", "q"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    starts, ends = tx.word_spans(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == [w for t in texts for w in words(t)]
    starts, ends = tx.line_spans(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == [line for t in texts for line in t.split("\n")]


def test_hashes_of_spans():
    """Equal spans have one hash wherever they stand; the Thue-Morse word and its complement differ."""
    rng = np.random.default_rng(8)
    data = rng.choice(np.frombuffer(b"ab \xff\x00", np.uint8), 5000)
    starts = rng.integers(0, 4900, 40_000)
    ends = starts + rng.integers(0, 9, 40_000)
    seen = {}
    for a, b, h in zip(starts, ends, tx.span_hash(tx.prefix_hash(data), starts, ends)):
        assert seen.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen) > 5000
    word = np.array([97], np.uint8)
    while len(word) < 4096:
        word = np.append(word, 195 - word)
    both = np.concatenate([word, 195 - word, word])
    at = np.array([0, 4096, 8192])
    one, other, again = tx.span_hash(tx.prefix_hash(both), at, at + 4096)
    assert one == again != other
    long = rng.integers(0, 256, 3 << 20).astype(np.uint8)
    tail = tx.span_hash(tx.prefix_hash(long), np.array([2 << 20]), np.array([3 << 20]))
    assert tail == tx.span_hash(tx.prefix_hash(long[2 << 20 :]), np.array([0]), np.array([1 << 20]))


def test_paragraph_links_over_several_rounds(spark):
    """A page of near copies larger than what the first round settles: each round asks for sets of its own pairs."""
    base = prose(88, 80).replace("\n", "")
    rows = [(i, edited(base, i, i % 3)) for i in range(2 * jaccard.SMALL)] + [(500, prose(5, 80).replace("\n", ""))]
    got = {r.doc_id: r.class_doc_id for r in paragraphs.classes(frame(spark, rows)).where("place = 0").collect()}  # place 0 is the whole line
    sets = {i: grams(t, paragraphs.SIZE) for i, t in rows}
    want = components(sets, linked(sets, *paragraphs.SHARE))
    assert got == {i: top for i, top in want.items() if list(want.values()).count(top) > 1}


def test_passages_in_mid_line_and_in_short_lines(spark):
    """A passage of PASSAGE words is found wherever it stands; a text alone is no repeat of itself."""
    def fresh(seed, n):
        return prose(seed, n).replace("\n", "")

    rows, planted = [], {}
    for k in range(12):
        w = fresh(9000 + k, paragraphs.PASSAGE).split(" ")
        short = "\n".join(" ".join(w[i : i + 7]) for i in range(0, len(w), 7))
        for j, passage in enumerate((" ".join(w), " ".join(w), short)):
            head = fresh(9100 + 3 * k + j, 30 + 3 * k) + " "
            rows.append((3 * k + j, head + passage + " " + fresh(9200 + 3 * k + j, 40)))
            planted[3 * k + j] = (len(head), len(head) + len(passage))
    rows += [(100 + i, fresh(9300 + i, 400)) for i in range(4)] + [(200, "one two three " * 200)]
    got = paragraphs.classes(frame(spark, rows)).collect()
    for k in range(12):
        inside = [{r.class_id for r in got if r.doc_id == d and planted[d][0] - 12 <= r.start and r.end <= planted[d][1] + 12} for d in range(3 * k, 3 * k + 3)]
        assert inside[0] & inside[1] & inside[2]
    assert all(r.doc_id < 100 for r in got)
    left = {r.doc_id: r.text for r in paragraphs.remove(frame(spark, rows)).collect()}
    text = dict(rows)
    assert all(left[i] == t for i, t in rows if i >= 100) and all(len(left[i]) < len(text[i]) for i in range(36) if i % 3)
    assert all(left[i].startswith(text[i][: planted[i][0] - 12]) for i in range(36))


def test_points_in_few_bytes_have_the_counts():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 16, jaccard.GROUPS - 1, jaccard.GROUPS, 900)]
    sets += [np.arange(300, dtype=np.uint64) * np.uint64(jaccard.GROUPS), np.arange(70_000, dtype=np.uint64) * np.uint64(jaccard.GROUPS)]
    points = [jaccard.point(s) for s in sets]
    assert [len(p) for p in points] == [1, 16, jaccard.GROUPS - 1, jaccard.GROUPS, jaccard.GROUPS, 2 * jaccard.GROUPS, 2 * jaccard.GROUPS]
    want = [np.bincount((s & np.uint64(jaccard.GROUPS - 1)).astype(np.int64), minlength=jaccard.GROUPS) for s in sets]
    want[-1][0] = 1 << 30  # no longer fits
    assert (jaccard.counts_of(points) == np.array(want)).all()


def test_paragraphs_that_meet_nothing_end_at_their_keys(spark, monkeypatch):
    """Only paragraphs that share a key are grouped, and points carry no sets; rows of one doc_id count once."""
    written = {}
    plain = paragraphs.materialise

    def counted(rows, name):
        out = plain(rows, name)
        written[name] = out.count(), out.columns
        return out

    monkeypatch.setattr(paragraphs, "materialise", lambda rows, name: counted(rows, name) if name in ("keyed_paragraphs", "paragraphs", "paragraph_points") else plain(rows, name))
    lone = [(i, prose(7000 + i, 300)) for i in range(40)]
    same, near = prose(6, 60).replace("\n", ""), prose(7, 60).replace("\n", "")
    rows = [*lone, (100, same), (101, same), (102, near), (103, edited(near, 1, 1)), (5, lone[5][1]), (200, prose(8, 90)), (200, prose(9, 90)), (None, same)]
    got = paragraphs.classes(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {100, 101, 102, 103}
    assert {(r.doc_id, r.class_doc_id) for r in got if r.place == 0} == {(100, 100), (101, 100), (102, 102), (103, 102)}
    assert len(got) <= written["paragraphs"][0] < 0.7 * written["keyed_paragraphs"][0]  # windows of one text that overlap meet, too
    assert written["paragraph_points"][1] == ["doc_id", "n_shingles", "point"]


def test_sketches_bound_what_two_sets_share():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**63, 9000).astype(np.uint64)
    heavy = np.arange(40_000, dtype=np.uint64) * np.uint64(1 << 20)  # all in one group
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 20, 127, 128, 1500, 2100, 6000)] + [heavy, heavy[:300]]
    for x in sets:
        for y in sets:
            shared = len(np.intersect1d(x, y))
            assert jaccard.sketch_bound(jaccard.sketch(x), jaccard.sketch(y)) >= shared
    one, other = (np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64)) for _ in "ab")
    assert jaccard.sketch_bound(jaccard.sketch(one), jaccard.sketch(other)) < 0.7 * len(one)
    assert len(jaccard.sketch(one)) <= len(one)


def test_long_texts_that_only_share_a_passage_are_not_verified_on_their_sets(spark, monkeypatch):
    """The counts of long texts are too alike for a bound of few groups; a sketch tells them apart."""
    verified = []
    plain = jaccard.materialise

    def counted(rows, name):
        out = plain(rows, name)
        if name == "links":
            verified.extend((r.a, r.b) for r in out.select("a", "b").collect())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    passage = prose(1, 12).replace("\n", "")
    rows = [(i, passage + " " + prose(600 + i, 6000)) for i in range(12)]
    rows += [(50, rows[3][1] + " and more"), (51, rows[3][1]), (52, rows[3][1]), (51, rows[3][1])]
    got = {r.doc_id: r.component_id for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == {i: 3 if i in (50, 51, 52) else i for i, _ in rows}
    assert verified == [(3, 50)]


def test_what_a_join_has_written_goes(spark):
    """Only the small tables that the result reads are left, and no shuffle files of finished queries are kept."""
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "chronoweave"
    base = prose(3, 80)
    rows = [(i, edited(base, i, i % 6)) for i in range(60)]
    for run in (jaccard.join, paragraphs.classes):
        before = set(folder.glob("*"))
        found = run(frame(spark, rows))
        left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
        assert not left & {"points", "sets", "pairs", "new_pairs", "owners", "star", "star_min", "keyed_paragraphs", "paragraph_points"}
        assert found.count() > 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_paragraphs_that_meet_only_in_their_own_text_end_at_their_keys(spark, monkeypatch):
    """Windows of one text that overlap share shingles, but are known not to link; they are not grouped or joined."""
    written = {}
    plain = paragraphs.materialise

    def counted(rows, name):
        written[name] = plain(rows, name)
        return written[name]

    monkeypatch.setattr(paragraphs, "materialise", lambda rows, name: counted(rows, name) if name == "paragraphs" else plain(rows, name))
    twice = prose(7999, 60).replace("\n", "")
    rows = [(i, prose(7100 + i, 400).replace("\n", "")) for i in range(20)] + [(50, twice + "\n" + prose(7998, 9) + "\n" + twice)]
    got = paragraphs.classes(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {50} and any(r.removed for r in got)
    assert {r.id // paragraphs.PLACES for r in written["paragraphs"].collect()} == {50}


def test_keys_of_one_text_end_whatever_the_batches():
    rng = np.random.default_rng(12)
    groups = [[k] * k for k in (1, 2, 3, 15)] + [[1, 1], [2, 2, 1], [0], [0, 0, 0], [0] * 40, [3, 3, 3] * 2, [15] * 30]  # marks of the rows of a key
    groups = [groups[i] for i in rng.integers(0, len(groups), 200)]
    rows = [(16 * i + mark, 1000 * i + j) for i, marks in enumerate(groups) for j, mark in enumerate(marks)]
    want = [(16 * i, 1000 * i + j) for i, marks in enumerate(groups) if marks[0] != len(marks) for j in range(len(marks))]
    for size in (1, 2, 7, 33, 10_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + size])], ["key", "doc_id"]) for lo in range(0, len(rows), size)]
        got = [r for b in paragraphs._shared_batches(iter(batches)) for r in zip(b["key"].to_pylist(), b["doc_id"].to_pylist())]
        assert got == want


def test_components_of_few_edges_take_one_step(spark, monkeypatch):
    """A graph of one chunk needs no rounds; one of more chunks than that has the same components."""
    rng = np.random.default_rng(8)
    edges = [tuple(e) for e in rng.integers(-60, 60, (70, 2)).tolist()] + [(100 + i, 101 + i) for i in range(40)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    want = components(nodes, [e for e in edges if e[0] != e[1]])
    written, plain = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda rows, name: written.append(name) or plain(rows, name))
    table = spark.createDataFrame(edges, "a long, b long")
    for chunk in (graph.CHUNK, 7):
        monkeypatch.setattr(graph, "CHUNK", chunk)
        got = graph.components(table).collect()
        assert len(got) == len(nodes) and {r.node: r.component for r in got} == want
        assert bool(written) == (chunk == 7)


def test_hashes_of_words_are_those_of_their_spans():
    rng = np.random.default_rng(9)
    for texts in (["", " Ab\tbC\n", "é\n\nx", "", "q", "Z" * 70_000], ["".join(rng.choice(list("aB \n\x0bé"), 40_000)) for _ in range(3)], [""], [" \n"]):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
        starts, ends = tx.word_spans(data, offsets)
        assert (tx.word_hash(data, starts, ends) == tx.span_hash(tx.prefix_hash(tx.LOWER[data]), starts, ends)).all()


def test_windows_start_at_the_first_smallest_of_any_neighbours():
    """Also where heads repeat, over several texts of all lengths."""
    rng = np.random.default_rng(10)
    for kinds in (1, 2, 5, 60, 10_000):
        lengths = rng.integers(0, 150, 40)
        rows = np.repeat(np.arange(40), lengths)
        words = rng.integers(0, kinds, len(rows)).astype(np.uint64)
        heads, want = tx.gram_hash(words, paragraphs.HEAD), set()
        for i in range(len(heads) - paragraphs.SPREAD + 1):
            if rows[i] == rows[i + paragraphs.SPREAD + paragraphs.HEAD - 2]:
                at = i + int(heads[i : i + paragraphs.SPREAD].argmin())
                if at + paragraphs.MIN_WORDS <= len(words) and rows[at] == rows[at + paragraphs.MIN_WORDS - 1]:
                    want.add(at)
        assert paragraphs._starts(words, rows).tolist() == sorted(want)


def test_windows_that_overlap_and_link_leave_the_first():
    """Against all pairs of windows of a text without lines that take part, in words that repeat more or less."""
    rng = np.random.default_rng(11)
    none, left_out = np.zeros(0, np.int64), 0
    for kinds in (2, 6, 30, 10_000):
        words = rng.integers(0, kinds, 1500).astype(np.uint64)
        words[500:900] = np.resize(words[500:507], 400)
        grams, rows = tx.gram_hash(words, paragraphs.SIZE), np.repeat([0, 1], 750)
        at = paragraphs._starts(words, rows)
        sets, kept = {a: set(grams[a : a + paragraphs.MIN_WORDS - paragraphs.SIZE + 1].tolist()) for a in at.tolist()}, []
        for a in at.tolist():
            near = [b for b in kept if a - b < paragraphs.MIN_WORDS and rows[a] == rows[b]]
            if not any(paragraphs._alike(len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for b in near):
                kept.append(a)
        got, flat, sizes = paragraphs._windows(words, grams, rows, none, none, grams[:0], none)
        assert got.tolist() == kept and [sorted(sets[a]) for a in kept] == [s.tolist() for s in np.split(flat, np.cumsum(sizes)[:-1])]
        left_out += len(at) - len(kept)
    assert left_out > 10


def test_points_come_with_the_keys_and_not_from_the_texts_again(spark, monkeypatch):
    """Texts are read again for the sets of pairs only; sets of many shingles beside others have their points, too."""
    made, written, plain, write = [], [], paragraphs._chosen, paragraphs.materialise
    monkeypatch.setattr(paragraphs, "_chosen", lambda *args: made.append(args) or plain(*args))
    monkeypatch.setattr(paragraphs, "materialise", lambda rows, name: written.append(name) or write(rows, name))
    same, far = prose(70, 60).replace("\n", ""), prose(71, 60).replace("\n", "")
    rows = [(1, same), (2, same), (3, far), (4, edited(far, 2, 1))]
    assert {r.doc_id for r in paragraphs.classes(frame(spark, rows)).collect()} == {1, 2, 3, 4}
    assert len(made) == written.count("sets") > 0
    text = "\n".join([" ".join(f"w{i}" for i in range(127)), prose(73, 40).replace("\n", ""), " ".join(f"v{i % 9}x{i}" for i in range(60)), " ".join(f"u{i}" for i in range(400)).replace("u7 ", "u7. ")])
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], ["doc_id", "text"])
    (out,) = paragraphs._find_batches(*paragraphs.tune(0.8))(iter([batch]))
    raw = np.frombuffer(text.encode(), np.uint8)
    want = {int(place): s for _, place, _, _, s in paragraphs._sets(raw, np.array([0, len(raw)]))}
    got = {r["id"] % paragraphs.PLACES: (r["n_shingles"], r["point"]) for r in out.to_pylist()}
    assert got == {place: (len(s), jaccard.point(s)) for place, s in want.items()} and max(map(len, want.values())) > jaccard.GROUPS


def test_names_of_a_key_are_in_order_whatever_the_batches(spark, monkeypatch):
    rng = np.random.default_rng(13)
    keys = np.sort(rng.integers(-40, 40, 600))
    rows = list(zip(keys.tolist(), rng.integers(0, 30, 600).tolist()))

    def ordered(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + size])], ["key", "doc_id"]) for lo in range(0, len(rows), size)]
        return [r for b in paragraphs._ordered_batches(iter(batches)) for r in zip(b["key"].to_pylist(), b["doc_id"].to_pylist())]

    assert all(ordered(size) == sorted(rows) for size in (1, 2, 33, 10_000))
    monkeypatch.setattr(paragraphs, "HELD", 3)
    for size in (1, 2, 33):
        got = ordered(size)
        assert [k for k, _ in got] == keys.tolist() and sorted(got) == sorted(rows)
    # Classes do not depend on it: a passage that many texts have, some of them nearly.
    same = prose(80, 60).replace("\n", "")
    docs = frame(spark, [(i, edited(same, i, i % 2) if i < 20 else same) for i in range(40)])
    small = {tuple(r) for r in paragraphs.classes(docs).collect()}
    monkeypatch.setattr(paragraphs, "HELD", 1 << 20)
    assert small == {tuple(r) for r in paragraphs.classes(docs).collect()} and len(small) > 40
