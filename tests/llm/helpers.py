"""Small tables and plain versions that the operators are held against."""

from __future__ import annotations

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, group string, size string"


def table(spark, rows):
    """Documents with further columns whose names clash with those that operators make."""
    full = [(*r, *[None] * (4 - len(r)), 1, "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, KINDS)


def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ids that occur twice, one long text."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "Eta", "tok"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(9000))
    near = " ".join(f"w{i}" for i in range(60))
    return [
        (1, "the quick brown fox", "en", "a"), (2, "the quick brown fox", "en", "a"), (2, "the quick brown fox", "en", "a"),
        (3, None, "en", None), (4, "", None, "b"), (5, " \n\t ", "en", "b"), (6, "one", "en", "b"), (7, "ONE", "fr", "c"),
        (None, "the quick brown fox", "en", "c"), (None, "something else", None, None), (8, long, "en", "a"),
        (9, near, "en", "a"), (10, near + " tail", "en", "b"), (11, near.upper(), "de", None),
        (12, "twice", "en", "a"), (12, "other text here", "en", "a"), (13, "ünï ß 日本 𝒳 it's 12\n\n  x  ", "de", "é"),
    ]


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(width)]))


def near_components(rows, width, percent=80):
    """doc_id -> smallest doc_id reachable, by comparing every pair."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}
