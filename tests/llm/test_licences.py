from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb

from chronoweave.llm import licences
from tests.llm.helpers import ODD, frame, prose
from tools.check import compare


def words(text):
    return re.findall(licences.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs):
    """Every template tried at every place of every document."""
    held = [(doc, words(t)) for doc, t in docs]
    df = Counter(w for _, ws in held for w in set(ws))
    rarity = lambda w: max(1, math.floor(1000 * math.log((len(docs) + 1) / (df[w] + 1))))
    anchors = [sorted(set(t.words), key=lambda w: (-rarity(w), w))[: licences.ANCHORS] for t in licences.TEMPLATES]
    out = []
    for doc, ws in held:
        places = []
        for t, rare in zip(licences.TEMPLATES, anchors):
            for begin in range(-len(t.words), len(ws)):
                at = lambda i: ws[begin + i] if 0 <= begin + i < len(ws) else None  # noqa: B023, E731
                if not any(at(i) == w for i, w in enumerate(t.words) if w in rare):
                    continue
                if all(at(p + i) == w for p, phrase in t.phrases for i, w in enumerate(phrase)):
                    share = sum(rarity(w) for i, w in enumerate(t.words) if at(i) == w) / sum(map(rarity, t.words))
                    if share >= licences.LEAST_SHARE:
                        places.append((begin, t.label, t.base, share))
        base = [p for p in places if p[2]]
        found = [",".join(sorted({p[1] for p in ps})) for ps in (base, places)]
        out.append((doc, len(ws), len(base), min((p[0] for p in base), default=None), max((p[0] for p in base), default=None), *found, max((p[3] for p in places), default=0.0)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    docs = [(i, prose(i, rng.randint(1, 60))) for i in range(80)]
    texts = [" ".join(t.words) for t in licences.TEMPLATES]
    docs += [(200 + i, f"{prose(i, 5)} {t.title()}. {prose(90 + i, 5)} {texts[i - 1]}") for i, t in enumerate(texts)]
    docs += [(300 + i, " ".join(w if rng.random() > 0.15 else "other" for w in t.split())) for i, t in enumerate(texts * 3)]
    docs += [(400, "CC-BY cc.by Cc  bY ccby cc by-sa 4.0 licensed under cc"), (401, "GNU General\nPublic-License, mit LICENSE mit license mitlicense"), (402, "license apache license apache license gnu general public"),
             (403, "mit licénse mit lİcense apacheé license"), (403, "mit license"), (404, "mit license " * 3000), (405, "by 4 0"), (None, "apache license")]
    return docs + ODD


def test_scan_equals_trying_every_place(spark):
    docs = corpus()
    got = licences.scan(frame(spark, docs))
    want = plain(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(w[6] != "" for w in want) > 50 and all(set(w[5].split(",")) <= set(w[6].split(",")) for w in want if w[5])
    assert [w for w in want if w[0] == 404][0][2] == 3000


def test_scan_equals_its_sql(spark):
    docs = frame(spark, corpus())
    con = duckdb.connect()
    held = docs.toPandas()
    con.register("documents", held.assign(doc_id=held["doc_id"].astype("Int64")))
    assert compare(licences.scan(docs).toPandas(), con.execute(licences.oracle_sql()).df()) == ""


def test_native_plan_and_empty_table(spark):
    assert licences.scan(frame(spark, [])).count() == 0
    plan = licences.scan(frame(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange|Join", plan)


def test_mandatory_phrases_stand_in_their_templates():
    for t in licences.TEMPLATES:
        assert all(t.words[at : at + len(p)] == p for at, p in t.phrases)
