"""Repair of conversation structure by block tables.

A conversation is to read: perhaps a system turn, then user and assistant turns in pairs.  The cheapest edits
follow from costs-to-go: for each of four states of that grammar, what the rows still to come will cost.
Vectors of costs are kept without their minimum, and only ``len(TABLES.vectors)`` of them exist.  For every
block of ``WIDTH`` symbols and every vector behind it the vector before it is precomputed, so a conversation
is worked off from its end, one lookup a block.  A block is expanded only for the trace: its inner vectors come
from the vector behind it, and at every row the first letter in ASCII order that keeps to the cheapest cost is
taken.  As the letters so far determine the state, this gives the least of all cheapest audits.

Conversations of any length are cut into segments of ``SEGMENT`` rows.  A segment's table composition says,
for every vector behind it and every state before it, what comes out on the other side; these few numbers are
joined up per conversation, and all segments are traced in parallel.  Only the final digest reads a
conversation's rows in one pass, in order and without holding them, as a hash cannot be joined from parts.

Defined cases: null conv_id is one conversation; null role and text count as one space; rows of one turn are
ordered by role and text; a role that does not begin with s, u or a can't be kept, nor can an empty one;
repeated rows are rows; an empty table has no conversation; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.series import index_rows
from chronoweave.storage import materialise

WIDTH = 4  # symbols of a block
SEGMENT = 65_536  # rows of a segment
SPACES = " \t\n\x0b\x0c\r"
KEY = ["void", "conv"]

# Costs and states of the grammar: 0 nothing yet, 1 after the system turn, 2 the user spoke, 3 the assistant spoke.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
NEXT = (2, 2, 3, 2)  # the state after the user's or assistant's turn that may follow
SPEAKER = {2: "u", 3: "a"}
AT_END = (0, 4, 2, 0)
TAIL = ("", "ua", "a", "")
ROLES = {"u": "user", "a": "assistant"}
# A symbol is 0 for a row that must go, else 1 + 2 * initial + truncated.
INITIALS = "sua"
SYMBOLS = 9


def _kept(symbol: int, state: int) -> int | None:
    """State after keeping a row, if it may be kept."""
    initial = (symbol - 1) // 2
    if initial == 0 and state == 0:
        return 1
    if initial == 1 and state != 2:
        return 2
    return 3 if initial == 2 and state == 2 else None


def _before(symbol: int, after: tuple[int, ...]) -> list[int]:
    """Costs-to-go before a row from those behind it."""
    own = [after[s] + DELETE for s in range(4)]
    if symbol:
        cut = CUT * ((symbol - 1) % 2)
        for s in range(4):
            own[s] = min(own[s], after[NEXT[s]] + REROLE + cut)
            if (kept := _kept(symbol, s)) is not None:
                own[s] = min(own[s], after[kept] + cut)
    for _ in range(3):  # rows inserted before it
        own = [min(own[s], own[NEXT[s]] + INSERT) for s in range(4)]
    return own


def _walk(symbol: int, after: tuple[int, ...], state: int) -> tuple[str, str, str, int]:
    """Inserted speakers, letter, what becomes of the row (k: kept) and the state behind it."""
    own, inserted = _before(symbol, after), ""
    cut = CUT * ((symbol - 1) % 2) if symbol else 0
    while True:
        follows = NEXT[state]
        if after[state] + DELETE == own[state]:
            return inserted, "D", "", state
        if own[follows] + INSERT == own[state]:
            inserted += SPEAKER[follows]
            state = follows
            continue
        kept = _kept(symbol, state)
        if kept is not None and after[kept] + cut == own[state]:
            return inserted, "K", "k", kept
        return inserted, "R", SPEAKER[follows], follows


class BlockTables:
    """Transitions of normalised vectors for blocks of one to ``width`` symbols."""

    def __init__(self, width: int):
        self.width, self.vectors = width, [tuple(c - min(AT_END) for c in AT_END)]
        place = {self.vectors[0]: 0}
        step, added, leaves = [], [], []
        for vector in self.vectors:  # grows while new vectors turn up
            own = [_before(s, vector) for s in range(SYMBOLS)]
            low = [tuple(c - min(o) for c in o) for o in own]
            for v in low:
                if v not in place:
                    place[v] = len(self.vectors)
                    self.vectors.append(v)
            step.append([place[v] for v in low])
            added.append([min(o) for o in own])
            leaves.append([[_walk(s, vector, state)[3] for state in range(4)] for s in range(SYMBOLS)])
        self.step = [np.array(step, np.int64).T]  # [symbols, vector behind] -> vector before
        self.added = [np.array(added, np.int64).T]
        self.leaves = [np.array(leaves, np.int64).transpose(1, 0, 2)]  # [symbols, vector behind, state before]
        count = len(self.vectors)
        for _ in range(1, width):
            step, added, leaves = self.step[-1], self.added[-1], self.leaves[-1]
            self.step.append(self.step[0][:, step].reshape(-1, count))
            self.added.append((self.added[0][:, step] + added).reshape(-1, count))
            middle = self.leaves[0][:, step]  # [symbol, rest, vector, state] -> state before the rest
            rest, vector = np.arange(len(step))[:, None, None], np.arange(count)[None, :, None]
            self.leaves.append(leaves[rest, vector, middle].reshape(-1, count, 4))

    def codes(self, symbols: np.ndarray) -> list[tuple[int, int]]:
        """(width, code) of the blocks of a run, the last one perhaps shorter."""
        out = []
        for begin in range(0, len(symbols), self.width):
            code = 0
            for s in symbols[begin : begin + self.width]:
                code = code * SYMBOLS + int(s)
            out.append((min(self.width, len(symbols) - begin), code))
        return out

    def compose(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a segment, for every vector behind it: vector before it, cost added, state behind it by state before."""
        vector = np.arange(len(self.vectors))
        cost = np.zeros(len(vector), np.int64)
        leaves = np.tile(np.arange(4), (len(vector), 1))
        for width, code in reversed(self.codes(symbols)):
            cost += self.added[width - 1][code][vector]
            leaves = np.take_along_axis(leaves, self.leaves[width - 1][code][vector], axis=1)
            vector = self.step[width - 1][code][vector]
        return vector, cost, leaves

    def trace(self, symbols: np.ndarray, behind: int, state: int) -> tuple[list[str], list[str], list[str]]:
        """Inserted speakers, letter and outcome of every row of a segment."""
        codes = self.codes(symbols)
        vectors = [behind]
        for width, code in reversed(codes[1:]):
            vectors.append(int(self.step[width - 1][code][vectors[-1]]))
        inserted, letters, become = [], [], []
        for (width, code), vector in zip(codes, reversed(vectors)):
            rows, state = self.expand(width, code, vector, state)
            for before, letter, out in rows:
                inserted.append(before)
                letters.append(letter)
                become.append(out)
        return inserted, letters, become

    @lru_cache(maxsize=1 << 16)  # noqa: B019 - one table per worker
    def expand(self, width: int, code: int, behind: int, state: int) -> tuple[list[tuple[str, str, str]], int]:
        """Edits of one block: inner vectors from the one behind it, then forward from the state before it."""
        symbols = [code // SYMBOLS ** (width - 1 - j) % SYMBOLS for j in range(width)]
        after = [behind]
        for s in reversed(symbols[1:]):
            after.append(int(self.step[0][s][after[-1]]))
        rows = []
        for s, vector in zip(symbols, reversed(after)):
            before, letter, out, state = _walk(s, self.vectors[vector], state)
            rows.append((before, letter, out))
        return rows, state


TABLES = BlockTables(WIDTH)


def keyed(turns: DataFrame) -> DataFrame:
    """Rows with a key without nulls."""
    conv = F.col("conv_id").cast("long")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(conv.isNull().alias("void"), F.coalesce(conv, F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by a checksum of conversation and turn."""
    part = lambda c, void: F.when(void, " ").otherwise(F.col(c).cast("string"))
    kind = F.crc32(F.concat(part("conv", F.col("void")), F.lit(":"), part("turn", F.col("turn").isNull()))) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(*KEY, "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Adds position ``i``, the first fault and the symbol of each row."""
    indexed, _ = index_rows(rows, KEY, ["turn", "role", "text"], derived=True)
    indexed = materialise(indexed, "turns")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = indexed.groupBy(*KEY, said.alias("said")).agg(F.min("i").alias("i")).select(*KEY, "i", F.lit(True).alias("new"))
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = (
        F.when(end == "", "blank")
        .when(F.col("new").isNull(), "duplicate")
        .when(~end.isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), len(INITIALS)).otherwise(initial)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * F.col("initial") + (F.col("fault") == "truncated").cast("int"))
    marked = indexed.join(first, [*KEY, "i"], "left").withColumns({"fault": fault, "initial": initial})
    return marked.select(*KEY, "i", "turn", "role", "text", "fault", F.col("initial").cast("int").alias("initial"), symbol.cast("int").alias("symbol"))


def _summaries(parts):
    """Composition of each segment, and its neighbouring roles that must not meet."""
    for pdf in parts:
        out = []
        for symbols, initials in zip(pdf["symbols"], pdf["initials"]):
            vector, cost, leaves = TABLES.compose(symbols)
            pairs = [illegal(a, b) for a, b in zip(initials[:-1], initials[1:])]
            out.append((vector.tolist(), cost.tolist(), leaves.ravel().tolist(), int(sum(pairs)), int(initials[0]), int(initials[-1])))
        fields = ["vector", "cost", "leaves", "illegal", "first", "last"]
        yield pdf[[*KEY, "seg"]].assign(**{f: [o[i] for o in out] for i, f in enumerate(fields)})


def illegal(a: int, b: int) -> bool:
    """Initials other than su, ua and au side by side."""
    return (int(a), int(b)) not in {(0, 1), (1, 2), (2, 1)}


def _join_up(parts):
    """Vector behind and state before each segment of a conversation, from its segments' compositions."""
    names = [*KEY, "seg", "behind", "state", "tail", "cost", "illegal"]
    for pdf in parts:
        out = []
        for void, conv, segments in zip(pdf["void"], pdf["conv"], pdf["segments"]):
            behind, vector, cost = [], 0, min(AT_END)
            for s in segments[::-1]:
                behind.append(vector)
                cost += int(s["cost"][vector])
                vector = int(s["vector"][vector])
            cost, state = cost + TABLES.vectors[vector][0], 0
            met = sum(illegal(a["last"], b["first"]) for a, b in zip(segments[:-1], segments[1:]))
            for s, v in zip(segments, reversed(behind)):
                leaves = int(s["leaves"][4 * v + state])
                out.append((void, conv, s["seg"], v, state, "", cost, s["illegal"] + met))
                state, cost, met = leaves, 0, 0  # the first segment carries what belongs to the whole
            out[-1] = (*out[-1][:5], TAIL[state], *out[-1][6:])
        yield pd.DataFrame(out, columns=names)


def _traces(parts):
    for pdf in parts:
        done = [TABLES.trace(s, v, q) for s, v, q in zip(pdf["symbols"], pdf["behind"], pdf["state"])]
        names = ["inserted", "letter", "become"]
        yield pdf[[*KEY, "seg", "tail"]].assign(**{n: [d[i] for d in done] for i, n in enumerate(names)})


def _digests(batches):
    """Audit and hash of each conversation; rows arrive in order and are not held."""
    key, out = None, []

    def row():
        return (*key, "".join(audit), digest.hexdigest(), lines)

    def flush():
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [*KEY, "audit", "repaired_sha256", "n_repaired"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for batch in batches:
        for void, conv, role, text, inserted, letter, become in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (void, conv):
                if key is not None:
                    out.append(row())
                key, audit, digest, lines = (void, conv), [], hashlib.sha256(), 0
            said = [(ROLES[x], "") for x in inserted]
            if become:
                said.append((role if become == "k" else ROLES[become], text))
            for who, what in said:
                digest.update((("\n" if lines else "") + f"{who}:{what}").encode())
                lines += 1
            audit.append("I" * len(inserted) + letter)
        yield flush()
        out.clear()
    if key is not None:
        out.append(row())
    yield flush()


def edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row the inserted speakers before it, its letter and outcome; per segment cost and illegal pairs.

    What is inserted at the very end stands on one more row behind the last.
    """
    ordered = F.array_sort(F.collect_list(F.struct("i", "symbol", "initial")))
    segments = rows.groupBy(*KEY, F.expr(f"i div {SEGMENT}").alias("seg")).agg(ordered.alias("a"))
    segments = materialise(segments.select(*KEY, "seg", F.col("a.symbol").alias("symbols"), F.col("a.initial").alias("initials")), "segments")
    key = "void boolean, conv long, seg long"
    parts = segments.mapInPandas(_summaries, f"{key}, vector array<int>, cost array<long>, leaves array<int>, illegal long, first int, last int")
    fields = F.struct("seg", "vector", "cost", "leaves", "illegal", "first", "last")
    whole = parts.groupBy(*KEY).agg(F.array_sort(F.collect_list(fields)).alias("segments"))  # a row per 65,536 turns
    joined = materialise(whole.mapInPandas(_join_up, f"{key}, behind int, state int, tail string, cost long, illegal long"), "joined")
    traced = segments.join(joined.select(*KEY, "seg", "behind", "state", "tail"), [*KEY, "seg"])
    traced = traced.select(*KEY, "seg", "symbols", "behind", "state", "tail").mapInPandas(
        _traces, f"{key}, tail string, inserted array<string>, letter array<string>, become array<string>"
    )
    each = F.arrays_zip("inserted", "letter", "become")
    end = F.array(F.struct(F.col("tail").alias("inserted"), F.lit("").alias("letter"), F.lit("").alias("become")))
    each = F.when(F.col("tail") == "", each).otherwise(F.concat(each, end))
    placed = traced.select(*KEY, "seg", F.posexplode(each).alias("p", "e"))
    return placed.select(*KEY, (F.col("seg") * SEGMENT + F.col("p")).alias("i"), "e.*"), joined


def repaired(turns: DataFrame, damaged: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their faults, edits of each row (joined to the rows) and figures of each segment."""
    rows = keyed(turns)
    rows = materialise(faults(damage(rows) if damaged else rows), "faults")
    changes, joined = edits(rows)
    return rows, changes.join(rows.select(*KEY, "i", "role", "text"), [*KEY, "i"], "left"), joined


def repair(turns: DataFrame, damaged: bool = False) -> DataFrame:
    """The repaired rows: conv_id, place (from 0 within the conversation, with gaps), part, role, text."""
    _, changed, _ = repaired(turns, damaged)
    new = F.transform(F.split("inserted", ""), lambda x: F.when(x == "u", "user").when(x == "a", "assistant"))
    added = F.transform(F.filter(new, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("role"), F.lit("").alias("text")))
    role = F.when(F.col("become") == "k", F.col("role")).when(F.col("become") == "u", "user").otherwise("assistant")
    own = F.when(F.col("become") != "", F.array(F.struct(role.alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    conv = F.when(~F.col("void"), F.col("conv"))
    return changed.select(conv.alias("conv_id"), F.col("i").alias("place"), F.posexplode(F.concat(added, own)).alias("part", "_e")).select(
        "conv_id", "place", "part", "_e.role", "_e.text"
    )


def audit(turns: DataFrame, damaged: bool = True) -> DataFrame:
    """Faults, cost, cheapest edits and hash of the repaired rows of every conversation."""
    rows, changed, joined = repaired(turns, damaged)
    count = lambda what: F.count_if(F.col("fault") == what).alias(what)
    wide = F.col("most").cast("decimal(20,0)") - F.col("least") + 1 - F.col("kinds")
    counts = rows.groupBy(*KEY).agg(
        F.max("turn").alias("most"), F.min("turn").alias("least"), F.count_distinct("turn").alias("kinds"), count("blank"), count("duplicate"), count("truncated")
    ).withColumn("gaps", wide.try_cast("long"))
    costs = joined.groupBy(*KEY).agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    stream = changed.repartition(*KEY).sortWithinPartitions(*KEY, "i").select(*KEY, "role", "text", "inserted", "letter", "become")
    digests = stream.mapInArrow(_digests, "void boolean, conv long, audit string, repaired_sha256 string, n_repaired long")
    every = keyed(turns).select(*KEY).distinct().join(counts, KEY, "left").join(costs, KEY, "left").join(digests, KEY, "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    conv = F.when(~F.col("void"), F.col("conv")).alias("conv_id")
    empty = hashlib.sha256().hexdigest()
    return every.select(conv, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def oracle_sql() -> str:
    """``audit`` of the damaged conversations by a recursive query over cost and audit of each state."""

    def add(value: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST(substr({value}, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({value}, 13) || '{letter}')"

    def least(*values: str) -> str:
        return f"least({', '.join(values)})"

    insert = lambda v: add(v, f"{INSERT}", "I")
    closed = {"v2": least("v2", insert("v0"), insert("v1"), insert("v3"))}
    closed["v3"] = least("v3", insert("v2"), insert(insert("v0")), insert(insert("v1")))
    keep = lambda v, initial: f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND initial = '{initial}' THEN {add(v, 'cut', 'K')} END"
    rerole = lambda v: f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {add(v, f'cut + {REROLE}', 'R')} END"
    delete = lambda v: add(v, f"{DELETE}", "D")
    step = [
        delete("v0"),
        least(delete("v1"), keep("v0", "s")),
        least(delete("v2"), *[f(v) for v in ("v0", "v1", "v3") for f in (lambda v: keep(v, "u"), rerole)]),
        least(delete("v3"), keep("v2", "a"), rerole("v2")),
    ]
    return rf"""WITH RECURSIVE bits AS (SELECT list(v ORDER BY i) AS t FROM (
      SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
    o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM o, bits),
    g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
    n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g),
    f AS (SELECT *, substr(role, 1, 1) AS initial, substr(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), -1) AS last,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS former FROM n),
    s AS (SELECT conv_id, turn, role, text, i, initial, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
      i > 1 AND former || initial NOT IN ('su', 'ua', 'au') AS met FROM f),
    a AS (SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (met) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS rows FROM s GROUP BY conv_id),
    r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM conversations
      UNION ALL SELECT conv_id, i, {step[0]}, {step[1]}, {step[2]}, {step[3]} FROM (
        SELECT s.conv_id, s.i, v0, v1, {closed["v2"]} AS v2, {closed["v3"]} AS v3, fault, initial, CASE WHEN fault = 'truncated' THEN {CUT} ELSE 0 END AS cut
        FROM r JOIN s ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.i = r.i + 1)),
    e AS (SELECT r.conv_id, {least("v0", closed["v3"])} AS best FROM r LEFT JOIN a ON r.conv_id IS NOT DISTINCT FROM a.conv_id WHERE i = coalesce(rows, 0)),
    b AS (SELECT conv_id, CAST(substr(best, 1, 12) AS BIGINT) AS cost, substr(best, 13) AS audit FROM e),
    l AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM b),
    m AS (SELECT *, substr(audit, p, 1) AS letter, p - len(replace(substr(audit, 1, p), 'I', '')) AS inserted, len(replace(substr(audit, 1, p - 1), 'D', '')) AS emitted FROM l),
    w AS (SELECT m.conv_id, p, letter, emitted, s.role, coalesce(s.text, '') AS text,
      first_value(letter = 'K' AND s.initial = 's') OVER (PARTITION BY m.conv_id ORDER BY letter = 'D', p) AS system
      FROM m LEFT JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND letter <> 'I' AND s.i = p - inserted),
    x AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (emitted - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS repaired
      FROM w WHERE letter <> 'D' GROUP BY conv_id)
    SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM b LEFT JOIN a ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN x ON b.conv_id IS NOT DISTINCT FROM x.conv_id"""
