from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import ODD, edited, frame, prose, words
from tests.llm.test_duplicates import components, grams, linked


def test_stages(spark, tmp_path):
    rows = [(i, edited(prose(i % 40, 80), i, i % 4), f"src{i % 3}") for i in range(160)]
    rows += [(300 + i, prose(800 + i, 50) + f" mail me{i}@corp.example", "src1") for i in range(10)]
    rows += [(400 + i, "junk %%% " * 40, "src2") for i in range(4)] + [(*r, "odd") for r in ODD] + [rows[3]]
    pd.DataFrame({"doc_id": [1, 2, 400], "quality": [1, 1, 0], "toxic": [0, 0, 0]}).to_parquet(tmp_path / "labels.parquet")
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == before.columns, name
        text[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = [i for i, _, _ in rows[:170]]
    assert set(clean) <= set(text["quality_rules"]) and not {400, 900, 901, None} & set(text["quality_rules"])
    sets = {i: grams(t, 5) for i, t in text["quality_rules"].items()}
    assert set(text["near_duplicates"]) == set(components(sets, linked(sets, 4, 5)).values())
    assert "<EMAIL>" in text["personal_data"][300] and "me0@" not in text["personal_data"][300]
    total = sum(len(words(t)) for t in text["personal_data"].values())
    taken = sum(len(words(r.text)) for r in docs.collect())
    assert total < taken <= 1.5 * total
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(zlib.crc32(np.array(tool.encode(r.text, add_special_tokens=False).ids + [1], "<u4")) for r in docs.collect())
    pieces = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).toPandas()
    assert pieces["length"].sum() == sum(len(tool.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert set(pieces[pieces["length"] == pieces["doc_tokens"]]["ids_crc32"]) <= set(want)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
