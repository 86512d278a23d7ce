"""Awkward documents, and a reference for words."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def awkward(n=60, seed=1):
    """Nulls in any column, empty, blank and long texts, repeated rows, non-ASCII."""
    import random

    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)] + ["Ünü", "don't", "naïve,", "x.", "日本語", "İstanbul", "\x85", "a\u00a0b"]
    rows = []
    for i in range(n):
        k = rng.choice([1, 2, 3, 5, 20, 80])
        text = rng.choice(["", " ", "\n"]).join([""]) + rng.choice([" ", "\t ", "\n"]).join(rng.choice(vocab) for _ in range(k))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "ß3", None]), len(text)))
    rows += [(n, None, "en", "s1", None), (n + 1, "", "en", "s2", 0), (n + 2, " \t\n", None, None, 3), (None, "null id here", "en", "s1", 12)]
    rows += [rows[3], rows[3], (n + 3, "long " * 30000, "en", "s2", 150000), (n + 4, rows[5][1], "de", "s9", 1)]
    return rows
