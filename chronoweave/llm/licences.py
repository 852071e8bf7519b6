"""Licence scan by a positional index of rare words, in DataFrame functions alone.

Templates are short passages of licences.  The index holds the ``ANCHORS`` rarest words of each template,
by document counts over the whole corpus, with their places.  In a file, every occurrence of an indexed word
is looked up: a posting names a template and, by the difference of the places, where the template would have
to begin.  Places named more than once are one candidate.  A candidate counts if the template's mandatory
phrases stand at their places; its share is the weight of all words of the template that stand in theirs.

The four base phrases are templates like the others; their one mandatory phrase is the whole, so every place
holds the rarest word and none is missed.  Everything happens within the row: texts are never shuffled, and
what is broadcast or collected is bounded by the templates (``TEMPLATES``, some 200 words).

Defined cases: a null text has no words; repeated rows, ties and null ``doc_id`` give rows of their own; words
of equal rarity are ordered by code point; a template reaching over a text's edge lacks those words; very
long texts are one row each; further columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHORS = 3  # indexed words of a template
LEAST_SHARE = 0.7  # weight of a template's words that must stand in their places
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BIG, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = 1 << 40  # above any place in a text

# Base phrases and their labels.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

# Passages of public licences: label, text, mandatory phrases.
PASSAGES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright", ["associated cc0 with this work", "waived all copyright"]),
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ["permission is hereby granted free of charge", "to any person obtaining a copy"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify", "with or without fee is hereby granted"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms", "are permitted provided that the following conditions"],
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ["source code form is subject to the terms", "mozilla public license"],
    ),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ["free and unencumbered software", "public domain"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
        ["express or implied warranty", "in no event will the authors be held liable"],
    ),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]  # places within the template
    base: bool


def _place(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def templates() -> list[Template]:
    out = [Template(label, tuple(text.split()), ((0, tuple(text.split())),), True) for label, text in BASE]
    for label, text, phrases in PASSAGES:
        words = text.split()
        out.append(Template(label, tuple(words), tuple((_place(words, p.split()), tuple(p.split())) for p in phrases), False))
    return out


TEMPLATES = templates()


def _words(texts: list[str]) -> Column:
    return F.array(*map(F.lit, texts))


def file_words(docs: DataFrame) -> DataFrame:
    """doc_id and all words of the text in order."""
    small = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), BIG, SMALL)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(small, F.lit(WORD), F.lit(0)).alias("words"))


def weights(docs: DataFrame, found: list[Template] = TEMPLATES) -> dict[str, int]:
    """Rarity of each template word: 1000 ln((documents + 1) / (documents with it + 1)), whole, 1 at least."""
    vocabulary = sorted({w for t in found for w in t.words})
    own = F.array_intersect("words", _words(vocabulary))  # distinct
    counted = file_words(docs).select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    held = {r["word"]: r["count"] for r in counted.collect()}  # at most one row per template word
    total = held.get("", 0)
    return {w: max(1, math.floor(1000 * math.log((total + 1) / (held.get(w, 0) + 1)))) for w in vocabulary}


def index(weight: dict[str, int], found: list[Template] = TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, place) of the rarest words of each template."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(found):
        for word in sorted(set(t.words), key=lambda w: (-weight[w], w))[:ANCHORS]:
            postings.setdefault(word, []).extend((number, place) for place, w in enumerate(t.words) if w == word)
    return postings


def _offsets(postings: dict[str, list[tuple[int, int]]]) -> Column:
    """The index as a literal map from a word to what each posting adds to the word's place."""
    each = [F.array(*[F.lit(number * STEP - place) for number, place in p]) for p in postings.values()]
    return F.map_from_arrays(_words(list(postings)), F.array(*each))


def _template_column(found: list[Template], weight: dict[str, int]) -> Column:
    rows = []
    for t in found:
        phrases = F.array(*[F.struct(F.lit(at).alias("at"), _words(list(p)).alias("words")) for at, p in t.phrases])
        rarity = F.array(*[F.lit(weight[w]).cast("long") for w in t.words])
        rows.append(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _words(list(t.words)).alias("words"), rarity.alias("rarity"), phrases.alias("phrases")))
    return F.array(*rows)


def scan(docs: DataFrame, found: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    ``score`` is the largest share of a template's weight that stands in the text, 0 without any.
    """
    weight = weights(docs, found)
    postings = index(weight, found)
    offsets = _offsets(postings)
    rows = file_words(docs)
    # Occurrences of indexed words: place and word.
    marked = F.transform("words", lambda w, i: F.when(w.isin(*postings), F.struct(i.cast("long").alias("place"), w.alias("word"))))
    rows = rows.select("doc_id", "words", F.filter(marked, lambda h: h.isNotNull()).alias("hits"))
    # Candidates: template * STEP + beginning, moved by one STEP so that beginnings before the text stay positive.
    named = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(offsets, h["word"]), lambda o: o + h["place"] + STEP // 2)))
    rows = rows.select("doc_id", "words", F.array_distinct(named).alias("named"))

    def standing(code: Column) -> Column:
        begin = (F.pmod(code, F.lit(STEP)) - STEP // 2).cast("int")
        t = F.element_at(_template_column(found, weight), (F.shiftright(code, 40) + 1).cast("int"))
        return F.struct(begin.alias("begin"), t.alias("t"))

    def stands(c: Column, words: Column) -> Column:
        at = lambda p: c["begin"] + p["at"]
        return F.forall(c["t"]["phrases"], lambda p: (at(p) >= 0) & (F.slice(words, F.greatest(at(p), F.lit(0)) + 1, F.size(p["words"])) == p["words"]))

    def share(c: Column, words: Column) -> Column:
        stood = F.transform(c["t"]["words"], lambda w, i: F.when(F.get(words, c["begin"] + i) == w, F.get(c["t"]["rarity"], i)).otherwise(F.lit(0)))
        total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
        return total(stood) / total(c["t"]["rarity"])

    candidates = F.transform("named", standing)
    rows = rows.select("doc_id", "words", F.filter(candidates, lambda c: stands(c, F.col("words"))).alias("kept"))
    scored = F.transform("kept", lambda c: F.struct(c["begin"].cast("long").alias("begin"), c["t"]["label"].alias("label"), c["t"]["base"].alias("base"), share(c, F.col("words")).alias("share")))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(scored, lambda c: c["share"] >= LEAST_SHARE).alias("places"))
    base = F.filter("places", lambda c: c["base"])
    rows = rows.select("doc_id", "n_words", "places", F.transform(base, lambda c: c["begin"]).alias("begins"), F.transform(base, lambda c: c["label"]).alias("base"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("begins").cast("long").alias("n_base"),
        F.array_min("begins").alias("first_word"),
        F.array_max("begins").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.transform("places", lambda c: c["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda c: c["share"])), F.lit(0.0)).alias("score"),
    )


def oracle_sql(found: list[Template] = TEMPLATES) -> str:
    """The same result by set operations in DuckDB."""
    text = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    tpl = ", ".join(f"({n}, '{t.label}', {t.base}, {text(t.words)})" for n, t in enumerate(found))
    phr = ", ".join(f"({n}, {at}, {text(p)})" for n, t in enumerate(found) for at, p in t.phrases)
    return rf"""WITH tpl(t, label, base, words) AS (VALUES {tpl}), phr(t, spot, words) AS (VALUES {phr}),
    d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{BIG}', '{SMALL}'), '{WORD}') AS w FROM documents),
    u AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS place FROM d),
    tw AS (SELECT t, unnest(words) AS word, unnest(range(len(words))) AS place FROM tpl),
    df AS (SELECT word, count(DISTINCT r) AS n FROM tw LEFT JOIN u USING (word) GROUP BY word),
    wt AS (SELECT word, greatest(1, CAST(floor(1000 * ln(((SELECT count(*) FROM d) + 1) / (n + 1))) AS BIGINT)) AS rarity FROM df),
    anchors AS (SELECT t, word FROM (SELECT DISTINCT t, word, rarity FROM tw JOIN wt USING (word))
      QUALIFY row_number() OVER (PARTITION BY t ORDER BY rarity DESC, word) <= {ANCHORS}),
    named AS (SELECT DISTINCT r, t, u.place - tw.place AS begin FROM u JOIN anchors USING (word) JOIN tw USING (t, word)),
    kept AS (SELECT r, t, begin FROM named JOIN d USING (r) JOIN phr USING (t) GROUP BY r, t, begin
      HAVING bool_and(begin + spot >= 0 AND list_slice(w, greatest(begin + spot, 0) + 1, greatest(begin + spot, 0) + len(words)) = words)),
    scored AS (SELECT r, t, begin, sum(CASE WHEN begin + place >= 0 AND w[greatest(begin + place, 0) + 1] = word THEN rarity ELSE 0 END) / sum(rarity) AS share
      FROM kept JOIN d USING (r) JOIN tw USING (t) JOIN wt USING (word) GROUP BY r, t, begin),
    places AS (SELECT * FROM scored JOIN tpl USING (t) WHERE share >= {LEAST_SHARE})
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, min(begin) FILTER (base) AS first_word, max(begin) FILTER (base) AS last_word,
      coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, coalesce(max(share), 0.0) AS score
    FROM d LEFT JOIN places USING (r) GROUP BY r, doc_id, w"""
