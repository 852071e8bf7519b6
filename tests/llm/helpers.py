"""Small document tables with the odd cases, and brute-force counterparts."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, bucket string, rank int"
WORDS = r"[^\x20\x09-\x0D]+"


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def frame(spark, rows):
    """(doc_id, text[, source]) rows with extra columns whose names the operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "b", 2) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
        out.append(w + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.03 else ""))
    return " ".join(out)


def edited(text: str, seed: int, edits: int) -> str:
    rng = random.Random(seed)
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "Z"), (904, "ñandú — naïve x y"), (905, "a\x00b " * 30), (None, "no id here at all"), (906, "<|endoftext|> don't stop, it's 3.14!!")]


def components(nodes, links) -> dict:
    above = {n: n for n in nodes}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        above[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}
