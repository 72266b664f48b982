"""Small documents with all that is awkward, and plain reference code."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def printed(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def letters(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def prose(rng, n):
    words = "the of and une maison élan straße ñandú house tree river stone light never again Zürich x 42 don't".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def odd_documents(seed=7, n=40):
    """(id, text): nulls, empty, blank, one word, a very long text, copies, near copies and shared passages."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "Word"), (4, "日本語のテキスト 🎉🎉"), (5, "a" * 700), (6, "be " * 300), (7, prose(rng, 4000))]
    for k in range(8, n):
        text = prose(rng, rng.randrange(5, 150))
        if k % 5 == 0:
            text += " " + passage
        if k % 7 == 0:
            text = out[rng.randrange(8, len(out) + 0)][1] if len(out) > 8 else text
        if k % 6 == 0 and len(out) > 8:
            words = out[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        out.append((k, text))
    return out
