"""License scan by a positional rare-token index; DataFrame operations only.

The template library gives each licence passage as words with their positions.  One pass over
the whole texts keeps the positions of library words; those of a few frequent words ("to", "and")
only in files that hold all other words of a phrase with them.  Document frequencies of the
words over all documents order every template's words by IDF.  A file is looked up by the rarest
word of a template; where it occurs, the template's postings (positions in the file less
position in the template) are intersected from rare to frequent, so what remains are the
places at which every word of the mandatory phrase stands in its relative position, the
frequent ones last.  Words of the passage outside the phrase only add to the score.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values: (label, passage, mandatory phrase).
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
TEMPLATES = [
    ("agpl", "gnu affero general public license version 3", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("bsl", "boost software license version 1 0", "boost software license"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("epl", "eclipse public license version 2 0", "eclipse public license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     "permission to use copy modify and or distribute this software"),
    ("lgpl", "gnu lesser general public license version 3", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("mpl", "mozilla public license version 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
]
#: Frequent words that are no lookup keys, as they would fill the postings of every file; outside
#: the mandatory phrase they do not count.
FREQUENT = set("to and in or the is of this for any a with are that without into".split())

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def library(base=BASE, templates=TEMPLATES) -> list[tuple[str, bool, list[tuple[int, str, bool]]]]:
    """(label, base, [(position, word, mandatory)]); positions count from the mandatory phrase."""
    rows = [(label, True, [(i, w, True) for i, w in enumerate(phrase.split())]) for label, phrase in base]
    for label, passage, phrase in templates:
        words, key = passage.split(), phrase.split()
        start = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        rows.append((label, False, [(i - start, w, start <= i < start + len(key))
                                    for i, w in enumerate(words)
                                    if start <= i < start + len(key) or w not in FREQUENT]))
    return rows


def _union(parts: list[Column], kind: str) -> Column:
    return F.flatten(F.array(*parts)) if parts else F.array().cast(kind)


def postings(docs: DataFrame, words: list[str], frequent: dict[str, list[list[str]]]) -> DataFrame:
    """doc_id, n_words and word -> positions (from 0) of the library words, for every row.

    A word of ``frequent`` is kept in files that hold every word of one of its lists.
    """
    low = F.translate(F.coalesce(docs["text"].cast("string"), F.lit("")), UPPER, LOWER)
    split = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"),
                        F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(words), F.struct(w.alias("w"), i.alias("i")))),
                    lambda h: h.isNotNull())
    found = split.select("doc_id", F.size("words").cast("bigint").alias("n_words"), hits.alias("hits"))
    if frequent:
        held = lambda ws: F.size(F.array_intersect("kinds", F.array(*map(F.lit, ws)))) == len(ws)
        found = found.withColumn("kinds", F.array_distinct(F.transform("hits", lambda h: h["w"])))
        found = found.withColumn("unwanted", _union([
            F.when(reduce(or_, map(held, lists)), F.array().cast("array<string>")).otherwise(F.array(F.lit(word)))
            for word, lists in frequent.items()], "array<string>"))
        found = found.withColumn("hits", F.filter("hits", lambda h: ~F.array_contains("unwanted", h["w"])))
    kinds = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    return found.select("doc_id", "n_words", F.map_from_arrays(kinds, F.transform(
        kinds, lambda k: F.transform(F.filter("hits", lambda h: h["w"] == k), lambda h: h["i"]))).alias("at"))


def scan_licenses(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    ``n_base`` counts all places of the base phrases, first_word and last_word are their
    smallest and largest start (null without any).  ``labels`` adds the labels of templates
    whose mandatory phrase is found; ``score`` is the largest share of a template's words that
    stand in their places, 0 without a label.  Null and empty texts have no words and no
    labels; null ids and repeated rows are rows like any other, each scanned by itself.
    Further columns are not looked at; an empty table gives an empty result.
    """
    rows = library(base, templates)
    words = sorted({w for _, _, parts in rows for _, w, _ in parts})
    frequent = {w: [sorted({x for _, x, m in parts if m and x not in FREQUENT}) for _, _, parts in rows
                    if any(m and x == w for _, x, m in parts)] for w in words if w in FREQUENT}
    frequent = {w: lists for w, lists in frequent.items() if all(lists)}
    found = written(postings(docs, words, frequent), "postings")
    # one row for each library word, however many documents there are
    frequency = {r["w"]: r["n"] for r in found.select(F.explode(F.map_keys("at")).alias("w"))
                 .groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = found.count()
    idf = {w: math.log((1 + total) / (1 + frequency.get(w, 0))) for w in words}

    def starts(word: str, at: int) -> Column:
        return F.transform(F.coalesce(F.col("at")[word], F.array().cast("array<int>")), lambda i: i - F.lit(at))

    for no, (_, _, parts) in enumerate(rows):
        rare_first = sorted((p for p in parts if p[2]), key=lambda p: (p[1] in FREQUENT, -idf[p[1]], p[0]))
        places = starts(rare_first[0][1], rare_first[0][0])
        for at, word, _ in rare_first[1:]:
            places = F.array_intersect(places, starts(word, at))
        found = found.withColumn(f"p{no}", F.when(
            F.map_contains_key("at", F.lit(rare_first[0][1])), places).otherwise(F.array().cast("array<int>")))

    def share(no: int, parts) -> Column:
        extra = [(at, w) for at, w, mandatory in parts if not mandatory]
        held = len(parts) - len(extra)
        if not extra:
            return F.when(F.size(f"p{no}") > 0, 1.0).otherwise(0.0)
        count = lambda s: sum(
            (F.array_contains(starts(w, at), s).cast("int") for at, w in extra), F.lit(held))
        return F.coalesce(F.array_max(F.transform(f"p{no}", count)) / F.lit(float(len(parts))), F.lit(0.0))

    def labels(only_base: bool) -> Column:
        names = [F.when(F.size(f"p{no}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
                 for no, (label, is_base, _) in enumerate(rows) if is_base or not only_base]
        return F.array_join(F.array_sort(F.array_distinct(_union(names, "array<string>"))), ",")

    places = F.concat(*[F.col(f"p{no}") for no, (_, is_base, _) in enumerate(rows) if is_base])
    return found.select(
        "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"),
        labels(True).alias("base_labels"), labels(False).alias("labels"),
        F.greatest(*[share(no, parts) for no, (_, _, parts) in enumerate(rows)]).alias("score"))
