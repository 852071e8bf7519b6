"""Token ids of whole texts, computed once per distinct piece.

A text is cut where both public vocabularies (byte-level and word-end BPE) start a new pre-token whatever
follows: before a white space after a visible character, between a single line feed after
a visible ASCII character and a visible character, and before ``.,;:!?`` after an ASCII letter.  The pieces of a run of texts are dictionary-encoded, only pieces not met before go through
the ``tokenizers`` library, and the ids are gathered for all pieces at once.  The ids equal those of the
whole text; strings of the vocabulary's special tokens get the special ids, as the library does by default.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from chronoweave.llm import text as tx

CACHE_PIECES = 800_000  # beyond this number a worker keeps the pieces of its last run alone
RUN_BYTES = 4 << 20
LOOK_BYTES = 1 << 18

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.zeros(256, bool)  # first bytes of characters that surely are no white space
_PLAIN[:128] = ~_BLANK[:128]
_PLAIN[0xC3] = True
_SEEN = _PLAIN & (np.arange(256) < 128)  # last bytes of characters that surely are no white space
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of a run of texts; every text that is not empty starts one."""
    mark = np.zeros(len(data), bool)
    for lo in range(0, len(data), LOOK_BYTES):
        skip = min(lo, 2)
        part = data[lo - skip : lo + LOOK_BYTES]
        blank = _BLANK[part]
        here = np.zeros(len(part), bool)
        at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        # After a character of several bytes only where it surely is no white space.
        sure = (part[at - 1] < 128) | (part[np.maximum(at - 2, 0)] == 0xC3)
        here[at[sure]] = True
        here[2:] |= _SEEN[part[:-2]] & (part[1:-1] == 10) & _PLAIN[part[2:]]
        here[1:] |= _STOP[part[1:]] & _LETTER[part[:-1]]
        mark[lo : lo + LOOK_BYTES] = here[skip:]
    mark[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(mark)


class Encoder:
    """One tokenizer of a worker with the ids of the pieces it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self.tokenizer.normalizer is not None and self.tokenizer.encode("The a", add_special_tokens=False).ids == self.tokenizer.encode(
            " the  A", add_special_tokens=False
        ).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.recent: list[str] = []
        self.ids, self.starts, self.n, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0, 0

    def _key(self, piece: str) -> str:
        """Pieces with one key have one encoding: case and outer blanks of ASCII text may not matter, but for special tokens."""
        if not self.plain or not piece.isascii():
            return piece
        key = piece.strip(" ").lower()
        return piece if any(token in key for token in self.special) else key

    def _learn(self, pieces: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        need_ids, need = self.used + int(counts.sum()), self.n + len(found) + 1
        if need_ids > len(self.ids):
            self.ids = np.resize(self.ids, max(need_ids, 2 * len(self.ids)))
        if need > len(self.starts):
            self.starts = np.resize(self.starts, max(need, 2 * len(self.starts)))
        self.ids[self.used : need_ids] = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        self.starts[self.n + 1 : need] = self.used + np.cumsum(counts)
        self.n, self.used = self.n + len(found), need_ids

    def _keep(self, pieces: list[str]) -> None:
        """Forget all pieces but these."""
        known, ids, starts = self.known, self.ids, self.starts
        held = {key: known[key] for key in map(self._key, pieces)}
        at = np.fromiter(held.values(), np.int64, len(held))
        counts = starts[at + 1] - starts[at]
        ends = np.cumsum(counts)
        self.ids = ids[np.arange(counts.sum()) + np.repeat(starts[at] - ends + counts, counts)]
        self.starts = np.append(0, ends)
        self.n, self.used = len(held), len(self.ids)
        self.known = {key: i for i, key in enumerate(held)}

    def places(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_PIECES:
            self._keep(self.recent)
        known, new, self.recent = self.known, [], pieces
        keys = list(map(self._key, pieces)) if self.plain else pieces
        found = list(map(known.get, keys))
        for i, at in enumerate(found):
            if at is None:
                at = known.get(keys[i])  # another piece with this key may have come before
                if at is None:
                    at = known[keys[i]] = self.n + len(new)
                    new.append(pieces[i])
                found[i] = at
        if new:
            self._learn(new)
        return np.array(found, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a run, and the place where each text's ids begin."""
        starts = cuts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        place = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        first = self.starts[place]
        counts = self.starts[place + 1] - first
        total = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        ids = self.ids[np.arange(total[-1]) + np.repeat(first - total[:-1], counts)]
        return ids, total[np.searchsorted(starts, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The tokenizer of this worker; it stays between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(path: str, column: pa.Array):
    """For runs of rows: first row, end row, ids, and the place where each row's ids begin."""
    tool = encoder(path)
    for lo, hi, data, offsets in tx.slices(column, RUN_BYTES):
        yield lo, hi, *tool.encode(data, offsets)
