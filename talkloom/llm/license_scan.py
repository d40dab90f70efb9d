"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of consecutive words, seen as a set: windows are twice as long as the longest
template and start at every multiple of its length, so that each run of words as long as a template lies whole in
one, however lines and comment marks break it. A block meets a template when it holds
at least THRESHOLD of the template's distinct words. The join orders words by their global
frequency (documents that hold them, over the whole table; ties by the word), rarest first, and
finds every such block by three exact filters:
  prefix: of a template with m words, of which o must be found, one of the m-o+1 rarest must be
    among the block's first n-o+1, n being the block's words that occur in any template;
  length: n must be at least o;
  position: a common word at places i and j leaves at most 1 + min(m-i, n-j) (places from 1)
    common words, which must be at least o.
What passes is verified exactly. Templates are a parameter, expanded as literals; their prefixes
are broadcast only while the templates have at most BROADCAST_WORDS words in all, else Spark
chooses the join. All steps are built-in expressions.

Beside the join, set phrases are located: every place where a phrase's words stand consecutively,
places that overlap included.

The table is read and split into words once: what is located, and the words of documents that could meet a template as a
whole, go to the shared folder; the frequencies and the join start from there.

Words: A-Z lower-cased, then maximal runs of characters other than U+0000-U+002F, U+003A-U+0060
and U+007B-U+007F. Defined results: a null text counts as empty and has no words, places or labels
(empty strings) and score 0; texts of any length are scanned whole; repeated rows, and rows that repeat an id, are scanned alike; an
empty table gives no rows; without templates no label is added, without phrases none is located;
columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import ascii_lower, written

THRESHOLD = 0.9
BROADCAST_WORDS = 100_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Opening words of well-known license texts and notices, by the label the join gives.
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0": "dedicated to the public domain under the CC0 1.0 Universal dedication",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "gpl-or-later": "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: Phrases located beside the join, with their labels.
PHRASES: dict[str, str] = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def words_of(text: str) -> list[str]:
    """The words, for the templates (which are ASCII) and for tests."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(BREAK, lower) if w]


def words_col(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _count(spaced: Column) -> Column:
    """Words of a string in which each has a space after it, and the first one before it."""
    return F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1


def places(words: Column, phrases: Mapping[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and the array of labels of the phrases found."""
    flat = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    n, first, last, labels = [F.lit(0)], [F.lit(None).cast("int")] * 2, [F.lit(None).cast("int")] * 2, [F.lit(None).cast("string")]
    for phrase, label in phrases.items():
        # only a text that holds the phrase is split, before each place
        parts = F.when(F.contains(flat, F.lit(f" {phrase} ")), F.split(flat, f"(?<= )(?={re.escape(phrase)} )"))
        some = parts.isNotNull()
        n.append(F.when(some, F.size(parts) - 1).otherwise(0))
        first.append(F.when(some, _count(F.element_at(parts, 1))))
        last.append(F.when(some, F.size(words) - _count(F.element_at(parts, -1)) - 1))
        labels.append(F.when(some, F.lit(label)))
    total = n[0]
    for x in n[1:]:
        total = total + x
    return {
        "n_base": total.cast("long"),
        "first_word": F.least(*first).cast("long"),
        "last_word": F.greatest(*last).cast("long"),
        "_base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def needed(words: int, threshold: float) -> int:
    """How many of a template's distinct words a block must hold."""
    return max(1, math.ceil(threshold * words - 1e-9))


def window(templates: Mapping[str, str]) -> int:
    """Words between the starts of windows; a window has twice as many."""
    return max((len(words_of(t)) for t in templates.values()), default=1) or 1


def frequencies(staged: DataFrame) -> dict[str, int]:
    """In how many documents each template word occurs; one row a word reaches the driver."""
    found = staged.select(F.explode("_known").alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def matches(staged: DataFrame, keys: list[str], sets: Mapping[str, list[str]], step: int, threshold: float = THRESHOLD) -> DataFrame:
    """keys, label and containment: each (document, template) met by a block, with the best block's share.

    staged: keys, _known (a document's template words) and _words (all of them, null where no template can be met).
    """
    spark = staged.sparkSession
    n_docs = frequencies(staged)
    ranked = sorted({w for s in sets.values() for w in s}, key=lambda w: (n_docs.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}
    rows, firsts = [], set()
    for label, words in sets.items():
        words = sorted(words, key=rank.get)
        m, o = len(words), needed(len(words), threshold)
        for i, w in enumerate(words[: m - o + 1]):
            firsts.add(w)
            rows.append(F.struct(F.lit(w).alias("word"), F.lit(i + 1).alias("i"), F.lit(label).alias("label"), F.lit(m).alias("m"), F.lit(o).alias("o"), F.array(*map(F.lit, words)).alias("all")))
    prefixes = spark.range(1).select(F.inline(F.array(*rows)))
    if sum(map(len, sets.values())) <= BROADCAST_WORDS:
        prefixes = F.broadcast(prefixes)
    least = min(needed(len(s), threshold) for s in sets.values())
    first_words = F.array(*map(F.lit, sorted(firsts)))
    in_order = F.array(*map(F.lit, ranked))  # array_intersect keeps the order of its first argument
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words"), F.lit(1)), F.lit(step))
    blocks = (
        staged.where(F.col("_words").isNotNull())
        .select(*keys, "_words", F.explode(starts).alias("_at"))
        .select(*keys, F.array_intersect(in_order, F.slice("_words", F.col("_at"), F.lit(2 * step))).alias("_words"))
        .where((F.size("_words") >= least) & F.arrays_overlap("_words", first_words))
    )
    pairs = blocks.select(*keys, "_words", F.size("_words").alias("n"), F.posexplode("_words").alias("j", "word")).withColumn("j", F.col("j") + 1)
    close = pairs.join(prefixes, "word").where(
        (F.col("n") >= F.col("o")) & (F.col("j") <= F.col("n") - F.col("o") + 1) & (1 + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= F.col("o"))
    )
    common = F.size(F.array_intersect("_words", "all"))
    return close.where(common >= F.col("o")).groupBy(*keys, "label").agg(F.max(common / F.col("m")).alias("containment"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels and score (the greatest
    containment of a template that is met, else 0)."""
    sets = {label: sorted(set(words_of(t))) for label, t in templates.items() if words_of(t)}
    none = F.array().cast("array<string>")
    array = lambda ws: F.array(*map(F.lit, ws)) if ws else none
    # equal rows have equal results, so a row is known by its id and a hash of its text
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_hash"), words_col(F.col(text)).alias("_words"))
    rows = rows.withColumn("_known", F.array_intersect(array(sorted({w for s in sets.values() for w in s})), "_words"))
    could = F.lit(False)
    for words in sets.values():
        could = could | (F.size(F.array_intersect("_known", array(words))) >= needed(len(words), threshold))
    base = [c.alias(k) for k, c in places(F.col("_words"), phrases).items()]
    staged = written(rows.select("_id", "_hash", F.size("_words").cast("long").alias("n_words"), *base, "_known", F.when(could, F.col("_words")).alias("_words")), "license-words")
    if sets:
        met = matches(staged, ["_id", "_hash"], sets, window(templates), threshold).groupBy("_id", "_hash").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_score"))
        met = met.select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "_labels", "_score")
        staged = staged.join(met, staged["_id"].eqNullSafe(met["_id2"]) & (staged["_hash"] == met["_hash2"]), "left")
    else:
        staged = staged.withColumns({"_labels": none, "_score": F.lit(0.0)})
    return staged.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_labels", none))), ",").alias("labels"),
        F.coalesce("_score", F.lit(0.0)).alias("score"),
    )
