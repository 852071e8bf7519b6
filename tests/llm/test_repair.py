from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np

from chronoweave.llm import repair
from tests.llm.helpers import prose
from tools.check import compare

TURNS = "conv_id long, turn long, role string, text string, i long, fault string, letter string"
GRAMMAR = re.compile("(s?(ua)+)?")


def fault_of(rows, i):
    role, text = rows[i]
    seen = re.findall(r"[^\x20\x09-\x0D]", text)
    if not seen:
        return "blank"
    if (role, text) in rows[:i]:
        return "duplicate"
    return "" if seen[-1] in ".!?" else "truncated"


def cheapest(rows):
    """Forward search over (row, state): cost, audit and repaired rows."""
    start = {"": (0, "", ())}
    follows = lambda state: "a" if state.endswith("u") else "u"

    def inserts(states):
        for _ in range(3):
            for state, (cost, audit, out) in list(states.items()):
                x = follows(state)
                new = (cost + 2, audit + "I", (*out, ({"u": "user", "a": "assistant"}[x], "")))
                states[x] = min(states.get(x, new), new, key=lambda v: v[:2])
        return states

    for i, (role, text) in enumerate(rows):
        fault, after = fault_of(rows, i), {}

        def offer(state, value):
            after[state] = min(after.get(state, value), value, key=lambda v: v[:2])  # noqa: B023

        cut = fault == "truncated"
        for state, (cost, audit, out) in inserts(start).items():
            offer(state, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            x = follows(state)
            offer(x, (cost + 2 + cut, audit + "R", (*out, ({"u": "user", "a": "assistant"}[x], text))))
            if role[:1] and (role[:1] == x or (role[:1] == "s" and state == "")):
                offer(role[:1], (cost + cut, audit + "K", (*out, (role, text))))
        start = after
    ends = [v for state, v in inserts(start).items() if state in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def plain(turns):
    text = lambda x: " " if x is None else x
    convs = defaultdict(list)
    for conv, turn, role, said in turns:
        rows = convs[conv]
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, said = text(role), text(said)
        said = "" if kind == 1 else re.sub("[.!?]", "", said) if kind == 2 else said
        rows += [(turn, "user" if kind == 4 else role, said)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        rows = [r[1:] for r in held]
        faults = [fault_of(rows, i) for i in range(len(rows))]
        seen = [r[0] for r in held if r[0] is not None]
        gaps = max(seen) - min(seen) + 1 - len(set(seen)) if seen else 0
        met = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, new = cheapest(rows)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), met, cost, audit, digest))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "Sys", "alice"]
    texts = ["yes.", "Well!", "no", "", " \t", None, "why? ", "wait…", "a\nb.", "x!  \n"]
    turns = []
    for conv in range(150):
        for turn in range(rng.randint(1, 14)):
            turns.append((conv, turn if rng.random() < 0.9 else rng.choice([None, 3, 40]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else prose(rng.randrange(10**6), 6)))
    for conv in range(500, 540):
        turns += [(conv, 0, "system", "Be brief.")] + [(conv, t + 1, ("user", "assistant")[t % 2], prose(conv * 50 + t, 5) + ".") for t in range(2 * (conv % 4))]
    turns += [(None, None, None, None), (None, 1, "user", "hi."), (None, 1, "user", "hi."), (-5, -7, "assistant", "ok. " * 20_000)]
    turns += [(900, t, ("user", "assistant")[t % 2], f"{t}." if t % 7 else "same.") for t in range(700)]
    return turns


def frame(spark, turns):
    return spark.createDataFrame([(*t, 1, "f", "l") for t in turns], TURNS)


def results(spark, turns):
    return sorted(map(tuple, repair.audit(frame(spark, turns)).collect()), key=repr)


def test_audits_equal_a_plain_search(spark):
    turns = corpus(1)
    assert results(spark, turns) == plain(turns)
    assert results(spark, []) == []


def test_segments_are_joined_up(spark, monkeypatch):
    turns = corpus(2)
    monkeypatch.setattr(repair, "SEGMENT", 5)
    assert results(spark, turns) == plain(turns)


def test_sql_gives_the_same(spark):
    turns = [t for t in corpus(3) if t[0] != 900]
    con = duckdb.connect()
    held = frame(spark, turns).toPandas()
    con.register("conversations", held.assign(conv_id=held["conv_id"].astype("Int64"), turn=held["turn"].astype("Int64")))
    assert compare(repair.audit(frame(spark, turns)).toPandas(), con.execute(repair.oracle_sql()).df()) == ""


def test_repaired_rows_read_well(spark):
    turns = corpus(4)
    got = defaultdict(list)
    for r in sorted(repair.repair(frame(spark, turns)).collect(), key=lambda r: (repr(r.conv_id), r.place, r.part)):
        got[r.conv_id].append(r)
    for rows in got.values():
        assert GRAMMAR.fullmatch("".join(r.role[:1] for r in rows))
    whole = [(c, t, r, x) for c, t, r, x in turns if c is not None and c >= 500 and c < 540 and c % 4]
    kept = [(r.conv_id, r.role, r.text) for c in got for r in got[c] if c is not None and 500 <= c < 540 and c % 4]
    assert sorted(kept) == sorted((c, r, x) for c, t, r, x in whole)


def test_letters_are_least_of_all_edit_strings():
    """Every string of edits up to some length, tried on short conversations."""
    rng = random.Random(5)
    for _ in range(60):
        symbols = [rng.randrange(repair.SYMBOLS) for _ in range(rng.randint(0, 3))]
        best = None
        for n in range(len(symbols) + 5):
            for letters in itertools.product("DIKR", repeat=n):
                state, at, cost = 0, 0, 0
                for x in letters:
                    if x == "I":
                        state, cost = repair.NEXT[state], cost + 2
                        continue
                    if at == len(symbols) or (x != "D" and not symbols[at]):
                        break
                    s, at = symbols[at], at + 1
                    new = state if x == "D" else repair.NEXT[state] if x == "R" else repair._kept(s, state)
                    if new is None:
                        break
                    cost += 3 if x == "D" else (2 if x == "R" else 0) + (s - 1) % 2
                    state = new
                else:
                    if at == len(symbols) and state in (0, 3):
                        best = min(best or (99, ""), (cost, "".join(letters)))
        inserted, letters, _ = repair.TABLES.trace(np.array(symbols, int), 0, 0)
        _, _, leaves = repair.TABLES.compose(np.array(symbols, int))
        audit = "".join("I" * len(i) + x for i, x in zip(inserted, letters)) + "I" * len(repair.TAIL[leaves[0][0]])
        assert audit == best[1]
