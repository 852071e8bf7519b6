"""Personal data: fixed patterns, and terms that reveal the values found.

``find`` makes one pass over the texts for the four base kinds and for the terms around every value
found.  A term (a run of letters, ASCII letters in lower case) reveals a value e when knowing the term
nearly tells the value: pointwise mutual information over the value's information content,
``PMI(t, e) / IC(e) = 1 + log2 P(e | t) / IC(e)``, reaches ``GENERALISE``; from ``REMOVE`` on the term is
removed.  Probabilities count documents of the whole corpus; a pair must be seen in ``SUPPORT`` different
surroundings, so that copies of one text are no evidence.

Three passes read the texts: the first finds values and their pairs, the second counts the documents of the
paired terms and gives one row per term and batch, and only terms that reveal something are looked up in
the third.  The filters of fixed size before the exact joins change no result.

Defined cases: a null or empty text has no spans; offsets are code points; repeated rows get equal spans,
and two rows with one doc_id but different texts keep their own; without values that recur no term is
added; an empty table gives an empty result; further columns are kept by ``sanitise``, not looked at, and may
have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm import sieve
from chronoweave.llm import text as tx
from chronoweave.storage import materialise

KINDS = ("email", "ip", "card", "phone")
NEAR = 8  # terms looked at on each side of a value
SUPPORT = 3  # different surroundings in which a pair must be seen
GENERALISE, REMOVE = 0.8, 1.0
SLOTS = 1 << 20
MIN_TERM = 3
SALTS = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True


def _luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) << (place & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each ``@`` so that long runs cost one look per character."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base matches, by kind and start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the terms of a run of texts."""
    starts, ends = tx.spans_of(_LETTER[data], offsets)
    long = ends - starts >= MIN_TERM
    starts, ends = starts[long], ends[long]
    return starts, ends, tx.span_hash(tx.prefix_hash(tx.LOWER[data]), starts, ends).view(np.int64)


def _pairs(text: str, raw: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[set[int], dict[tuple[int, int], int]]:
    """Values of a text, and for each (value, nearby term) the hash of its first surroundings."""
    starts, ends, terms = _terms(raw, np.array([0, len(raw)]))
    values, pairs = set(), {}
    for kind, s, e in spans:
        said = text[s:e].lower() if kind == 0 else re.sub(r"[^0-9.]", "", text[s:e])
        key = np.frombuffer(f"{kind}:{said}".encode(), np.uint8)
        value = int(tx.span_hash(tx.prefix_hash(key), np.array([0]), np.array([len(key)])).view(np.int64)[0])
        values.add(value)
        lo = len(text[:s].encode())
        hi = lo + len(text[s:e].encode())
        before = int(np.searchsorted(ends, lo, "right"))
        after = int(np.searchsorted(starts, hi))
        around = np.concatenate([terms[max(0, before - NEAR) : before], terms[after : after + NEAR]])
        place = int(tx.gram_hash(around.view(np.uint64), len(around)).view(np.int64)[0]) if len(around) else 0
        for term in around.tolist():
            pairs.setdefault((value, term), place)
    return values, pairs


FOUND = (
    "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, pairs array<struct<entity:long,term:long,place:long>>"
)
_PAIR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("place", pa.int64())]))


def _find_batches(batches):
    for batch in batches:
        n = batch.num_rows
        counts, base, entities, pairs = np.zeros((4, n), np.int64), [""] * n, [[]] * n, [[]] * n
        column = batch.column("text")
        for lo, _, data, offsets in tx.slices(column):
            worth = tx.sums_between(_DIGITS[data] | (data == 64), offsets) > 0
            for row in np.flatnonzero(worth):
                raw = data[offsets[row] : offsets[row + 1]]
                text = raw.tobytes().decode()
                if not (spans := base_spans(text)):
                    continue
                at = lo + row
                for kind, _, _ in spans:
                    counts[kind, at] += 1
                base[at] = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
                values, near = _pairs(text, raw, spans)
                entities[at] = sorted(values)
                pairs[at] = [{"entity": v, "term": t, "place": p} for (v, t), p in near.items()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), *map(pa.array, counts), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.int64())), pa.array(pairs, _PAIR)],
            ["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "pairs"],
        )


def _wanted(slots: np.ndarray) -> np.ndarray:
    wanted = np.zeros(SLOTS, bool)
    wanted[slots] = True
    return wanted


def _term_batches(slots: np.ndarray):
    """Documents of each paired term in a batch."""
    wanted = _wanted(slots)

    def run(batches):
        for batch in batches:
            held = [np.zeros(0, np.int64)]
            for _, _, data, offsets in tx.slices(batch.column("text")):
                starts, _, terms = _terms(data, offsets)
                hit = wanted[terms.view(np.uint64) & np.uint64(SLOTS - 1)]
                terms, row = terms[hit], tx.rows_of(starts, offsets)[hit]
                order = np.lexsort((row, terms))
                terms, row = terms[order], row[order]
                held.append(terms[np.append(True, (terms[1:] != terms[:-1]) | (row[1:] != row[:-1]))[: len(terms)]])
            terms, n = np.unique(np.concatenate(held), return_counts=True)
            if len(terms):
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], ["term", "n"])

    return run


HITS = "doc_id long, text_key long, term long, start long, end long"


def _hit_batches(slots: np.ndarray):
    wanted = _wanted(slots)

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for lo, _, data, offsets in tx.slices(batch.column("text")):
                starts, ends, terms = _terms(data, offsets)
                hit = wanted[terms.view(np.uint64) & np.uint64(SLOTS - 1)]
                if not hit.any():
                    continue
                starts, ends, terms = starts[hit], ends[hit], terms[hit]
                row = tx.rows_of(starts, offsets)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = chars[offsets[row]]
                at = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), pa.array(terms), pa.array(chars[starts] - base), pa.array(chars[ends] - base)], ["doc_id", "text_key", "term", "start", "end"]
                )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))


def _term_slots(rows: DataFrame) -> np.ndarray:
    return np.array([r[0] for r in rows.select(F.col("term").bitwiseAND(SLOTS - 1)).distinct().collect()], np.int64)  # at most SLOTS


def revealing_terms(found: DataFrame, keyed: DataFrame) -> DataFrame | None:
    """Terms with the largest disclosure ratio over all values, where it reaches ``GENERALISE``."""
    pair = found.where(F.size("pairs") > 0).select(F.explode("pairs").alias("p")).select("p.*")
    seen = pair.groupBy("entity", "term", "place").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.groupBy("entity", "term").agg(F.sum("n").alias("joint"), F.count(F.lit(1)).alias("places"))
    seen = materialise(seen.where(F.col("places") >= SUPPORT), "pii_pairs")
    slots = _term_slots(seen)
    if not len(slots):
        return None
    counted = keyed.select("text").mapInArrow(_term_batches(slots), "term long, n long")
    by_term = counted.groupBy("term").agg(F.sum("n").alias("term_docs"))
    by_value = found.where(F.size("entities") > 0).select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("value_docs"))
    total = found.count()
    content = F.log2(F.lit(float(max(total, 2))) / F.col("value_docs"))
    ratio = F.lit(1.0) + F.log2(F.least(F.col("joint") / F.col("term_docs"), F.lit(1.0))) / F.greatest(content, F.lit(1e-9))
    rows = seen.join(by_term, "term").join(by_value, "entity").withColumn("ratio", ratio)
    return materialise(rows.groupBy("term").agg(F.max("ratio").alias("ratio")).where(F.col("ratio") >= GENERALISE), "pii_terms")


def find(docs: DataFrame) -> DataFrame:
    """Counts, base spans and all spans (``kind:start:end``, comma-joined) of every document."""
    keyed = _keyed(docs)
    found = materialise(keyed.mapInArrow(_find_batches, FOUND), "pii_found")
    terms = revealing_terms(found, keyed)
    rows = found.drop("entities", "pairs")
    if terms is None or not len(slots := _term_slots(terms)):
        return rows.withColumn("spans", F.col("base"))
    hits = keyed.mapInArrow(_hit_batches(slots), HITS)
    kind = F.when(F.col("ratio") >= REMOVE, "gone").otherwise("term")
    # A common term has very many hits: they are dealt over SALTS parts, each with a copy of the term's row.
    terms = terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = hits.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    spans = hits.join(terms, ["term", "part"]).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end", kind.alias("kind"))).alias("added"))
    parts = F.split("base", ",")
    inside = lambda x: F.exists(  # noqa: E731 - a term inside a base span adds nothing
        parts, lambda b: (F.split(b, ":")[1].cast("long") < x["end"]) & (F.split(b, ":")[2].cast("long") > x["start"])
    )
    kept = F.filter(F.array_sort("added"), lambda x: (F.col("base") == "") | ~inside(x))
    text = lambda name: F.array_join(F.transform(F.filter(kept, lambda x: x["kind"] == name), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    joined = rows.join(spans, ["doc_id", "text_key"], "left")
    full = F.array_join(F.filter(F.array("base", text("term"), text("gone")), lambda s: s != ""), ",")
    return joined.withColumn("spans", F.coalesce(full, F.col("base"))).drop("added")


def redact(text: str, spans: str) -> str:
    """Text with every span replaced by its kind; spans that touch become one."""
    marks = sorted((int(s), int(e), k) for k, s, e in (part.split(":") for part in spans.split(",")))
    out, at = [], 0
    for s, e, kind in marks:
        if s >= at:
            out += [text[at:s], "" if kind == "gone" else f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _redact_batches(mark: str):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            text, spans = batch.column("text").to_pylist(), batch.column(mark).to_pylist()
            new = pa.array([redact(t, s) if s else t for t, s in zip(text, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in names if c != mark], [c for c in names if c != mark])

    return run


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by its kind and revealing terms generalised or removed.

    Only rows that may have spans are joined with them; the others stay where they are.
    """
    found = find(docs).where(F.col("spans") != "").select("doc_id", "text_key", "spans").distinct()
    found = materialise(found, "pii_spans")
    doc_id, key = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    near, far = sieve.sift(docs, sieve.slot(doc_id, key), found.select(sieve.slot(F.col("doc_id"), F.col("text_key")).alias("m")))
    t = sieve.free_name(docs)
    # One plan at every size; and the join's shuffle keeps the two Python steps in tasks of their own.
    marks = found.hint("merge").select(*(F.col(c).alias(t + c) for c in found.columns))
    joined = near.join(marks, doc_id.eqNullSafe(F.col(f"{t}doc_id")) & (key == F.col(f"{t}text_key")), "left").drop(f"{t}doc_id", f"{t}text_key")
    kinds = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields])
    return joined.mapInArrow(_redact_batches(f"{t}spans"), kinds).unionByName(far)
