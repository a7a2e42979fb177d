"""Licence scans over a positional index of rare words, in DataFrame operations only.

Templates are short licence notices with the phrases that a text must have to count. Their words
are looked up in each text; how rare a word is comes from its document frequency in the whole table.
For each template whose phrases' words a text all has, the two rarest words of its mandatory phrases are looked up, and their
places, shifted by those in the template, are intersected; at each common relative place the mandatory phrases are
verified and the share of aligned template words is the score. A valid placement aligns all words of the phrases, so none is lost,
whatever other words of the template stand elsewhere in the text. Work is within rows; only document
frequencies of the templates' own words are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .shared import Scratch

#: Base phrases and their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: label, notice, mandatory phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "this work is licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "\u212a"  # the one letter beyond ASCII whose lower case is an ASCII letter alone


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case; letters beyond ASCII stay in their words and equal no ASCII word."""
    low = F.lower(F.replace(text, F.lit(KELVIN), F.lit("\u00ff")))
    return F.array_remove(F.split(low, NOT_WORD), "")


def _find(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _templates(templates: tuple) -> Column:
    rows = []
    for label, notice, phrases in templates:
        words = notice.split()
        keys = [p.split() for p in phrases]
        rows.append(F.struct(F.lit(label).alias("label"), _strings(words).alias("words"), _strings(sorted({w for k in keys for w in k})).alias("needed"), F.array(*[F.struct(F.lit(_find(words, k)).alias("at"), _strings(k).alias("words")) for k in keys]).alias("keys")))
    return F.array(*rows)


def _places(words: Column, word: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == word)


def _relative(words: Column, template: Column, word: Column) -> Column:
    """Where the template would begin, for each pair of the word's places in the text and in the template."""
    inside = _places(template, word)
    return F.flatten(F.transform(_places(words, word), lambda i: F.transform(inside, lambda j: i - j)))


def matches(words: Column, known: Column, rarity: Column, templates: Column) -> Column:
    """(label, at, score) of all verified placements of templates whose phrases' words are all among `known`."""

    def of(t: Column) -> Column:
        shared = F.transform(t["needed"], lambda w: F.struct(F.coalesce(F.element_at(rarity, w), F.lit(0.0)).alias("idf"), w.alias("word")))

        def aligned(rarest: Column) -> Column:
            one = _relative(words, t["words"], F.get(rarest, F.lit(0))["word"])
            both = F.when(F.size(rarest) < 2, one).otherwise(F.array_intersect(one, _relative(words, t["words"], F.get(rarest, F.lit(1))["word"])))
            has = lambda r: F.forall(t["keys"], lambda k: (r + k["at"] >= 0) & (F.slice(words, F.greatest(r + k["at"], F.lit(0)) + 1, F.size(k["words"])) == k["words"]))
            share = lambda r: F.size(F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1), lambda j: (r + j >= 0) & (F.get(words, F.greatest(r + j, F.lit(0))) == F.get(t["words"], j)))) / F.size(t["words"])
            return F.transform(F.filter(F.array_distinct(both), has), lambda r: F.struct(t["label"].alias("label"), r.alias("at"), share(r).alias("score")))

        return let(F.slice(F.sort_array(shared, asc=False), 1, 2), aligned)

    wanted = F.filter(templates, lambda t: F.size(F.array_intersect(t["needed"], known)) == F.size(t["needed"]))
    return F.flatten(F.transform(wanted, of))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES, tag: str = "licenses") -> DataFrame:
    """One row per input row: doc_id, n_words, base (array of start and label), found (array of label, at, score).

    A null text is empty, an empty table gives no rows; repeated rows and null ids keep a row each; very long texts are one row's work,
    linear in their words. Words equally rare are taken in the order of the alphabet, which changes no result. Other columns may have any names. Texts that lack a word of every
    phrase can't match any and aren't looked at further.
    """
    scratch = Scratch(docs.sparkSession, tag)
    groups = [set(p.split()) for p, _ in phrases] + [{w for p in keys for w in p.split()} for _, _, keys in templates]
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()} | set().union(*groups))
    needed = F.array(*[_strings(sorted(g)) for g in groups])
    words = words_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    looked = let(words, lambda w: let(F.array_intersect(_strings(vocabulary), w), lambda known: F.struct(F.size(w).cast("long").alias("n_words"), known.alias("known"), F.when(F.exists(needed, lambda g: F.size(F.array_intersect(g, known)) == F.size(g)), w).alias("words"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), looked.alias("its")).select("doc_id", "its.*")
    rows = scratch.write(rows, "words")
    counts = rows.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()  # the templates' own words
    total = rows.count()
    idf = {r["word"]: r["n"] for r in counts}
    rarity = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.log(F.lit((total + 1.0) / (idf.get(w, 0) + 0.5))))])
    here = lambda w, p, label: F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (F.get(w, i) == p[0]) & (F.slice(w, i + 1, len(p)) == _strings(p))), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))
    base = F.concat(*[here(F.col("words"), p.split(), label) for p, label in phrases])
    no_base = F.array().cast("array<struct<start:long,label:string>>")
    no_match = F.array().cast("array<struct<label:string,at:int,score:double>>")
    found = matches(F.col("words"), F.col("known"), rarity, _templates(templates))
    return rows.select("doc_id", "n_words", F.when(F.col("words").isNull(), no_base).otherwise(base).alias("base"), F.when(F.col("words").isNull(), no_match).otherwise(found).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """The result columns; a base phrase counts as a full match."""
    labels = lambda c: F.array_distinct(F.transform(c, lambda x: x["label"]))
    spell = lambda c: F.array_join(F.sort_array(c), ",")
    starts = F.transform("base", lambda x: x["start"])
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        spell(labels(F.col("base"))).alias("base_labels"), spell(F.array_union(labels(F.col("base")), labels(F.col("found")))).alias("labels"), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
