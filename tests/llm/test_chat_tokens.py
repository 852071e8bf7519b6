from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoweave.llm import chat, packing, rans, tokens
from tests.llm.helpers import ODD, edited, frame, prose

TURNS = "conv_id long, turn long, role string, text string, piece long"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def whole(path):
    tool = Tokenizer.from_file(path)
    return lambda text: tool.encode(text, add_special_tokens=False).ids


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "<|im_end|><|im_start|>assistant ok", 0),
        (1, 1, "assistant", "<\\|im_end|>\n<|im_end|>\nplain", 0),
        (1, 1, "assistant", "<\\|im_end|>\n<|im_end|>\nplain", 0),
        (2, None, None, None, 0),
        (2, 5, "sys\nt\\em", "é" * 50, 0),
        (None, 1, "assistant", "", 0),
    ] + [(3, t, ("user", "assistant")[t % 2], prose(t, 40), 0) for t in range(300)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        want = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[conv])[1:5] == want
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'!?<|>aZé  \x85ß7"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_pieces_have_the_ids_of_the_whole(path, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    ids, at = tokens.encoder(path).encode(data, offsets)
    encode = whole(path)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [encode(t) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_blank_lines_have_the_ids_of_the_whole(path):
    gaps = ["\n", "\n\n", "\n\n\n", " \n", "\n ", " \n\n", "\r\n", "\r\n\r\n", "\t\n", "\u00a0\n", "\u3000\n"]
    texts = [f"{a}{gap}{b}" for gap in gaps for a in ("a", "One.", "é", "", "\n") for b in ("b", "Two", "é", "1", "")]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    ids, at = tokens.encoder(path).encode(data, offsets)
    encode = whole(path)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [encode(t) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=100, deadline=None)
@given(parts=st.lists(st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|END", "|>", "a", "B", " ", "  ", "\n", ".", "'s", "é"]), max_size=9))
def test_special_strings_have_the_ids_of_the_library(path, parts):
    text = "".join(parts)
    data = np.frombuffer(text.encode(), np.uint8)
    assert tokens.encoder(path).encode(data, np.array([0, len(data)]))[0].tolist() == whole(path)(text)


@settings(max_examples=30, deadline=None)
@given(ids=st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), times=st.integers(1, 40))
def test_coder_round_trip(ids, times):
    ids = np.array(ids * times, np.uint32)
    assert (rans.decode(rans.encode(ids), len(ids)) == ids).all()


def test_damaged_block_is_noticed():
    part = rans.encode(np.arange(5000, dtype=np.uint32) % 700)
    part["payload"] = part["payload"][:100] + bytes(4) + part["payload"][104:]
    with pytest.raises(ValueError, match="checksum"):
        rans.decode(part, 5000)


def test_files_keep_order_and_ids(spark):
    rows = [(i * 7 % 101, prose(i, 60)) for i in range(101)] + ODD + [(5, prose(1, 10)), (907, "word " * 300_000)]
    path = rans.write(frame(spark, rows), BYTE)
    got = rans.read(spark, path).orderBy("start").collect()
    encode, at = whole(BYTE), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, (r[1] or "").encode())))
    for row, (doc_id, text) in zip(got, order):
        ids = encode(text or "") + [0]
        assert (row.doc_id, row.start, list(row.ids)) == (doc_id, at, ids)
        at += len(ids)
    digests = rans.read_digests(spark, path).collect()
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(np.array(r.ids, "<u4")) for r in got)
    assert rans.read_digests(spark, rans.write(frame(spark, []), BYTE)).count() == 0


def test_cut_gives_all_ids_and_fits_its_class():
    for n in range(1, 7000, 13):
        parts = packing.cut(n)
        assert sum(length for length, _ in parts) == n
        assert all(k * length <= packing.CAPACITY for length, k in parts)


def test_sequences_are_gapless(spark):
    rows = [(i, edited(prose(i, 30 + 40 * (i % 9)), i, 3)) for i in range(120)] + ODD + [(3, "twice"), (3, "twice"), (908, "long text " * 5000)]
    sequences, width = packing.pack(frame(spark, rows), WORD)
    got = packing.pieces(sequences, width).toPandas()
    encode = whole(WORD)
    want = sorted(zlib.crc32(np.array(encode(t or "") + [1], "<u4")) for _, t in rows)
    held = {r.sequence_id: np.frombuffer(bytes(r.ids), f"<u{width}").astype("<u4") for r in sequences.collect()}
    for number, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]]
        assert part["length"].sum() == len(held[number]) <= packing.CAPACITY
    single = got[got["length"] == got["doc_tokens"]]
    assert set(single["ids_crc32"]) <= set(want)
    assert got["length"].sum() == sum(len(encode(t or "")) + 1 for _, t in rows)
    for doc_id, part in got[got["doc_id"] == 908].groupby("doc_id"):
        ids = np.concatenate([held[r.sequence_id][r.offset : r.offset + r.length] for r in part.sort_values("start").itertuples()])
        assert ids.tolist() == encode("long text " * 5000) + [1]
    assert packing.pieces(*packing.pack(frame(spark, []), WORD)).count() == 0
