"""License scans: an exact set-similarity join of text blocks with license templates, with Spark SQL functions only.

Texts are cut into overlapping blocks of words. A block meets a template if it
contains at least the threshold's share of the template's distinct words. Words
are ordered by their frequency over all blocks, rarest first. A pair that meets
the threshold shares one of the template's first words in that order (prefix
filter); the block must hold enough template words at all (length filter), and
what follows the shared word in both must still suffice (positional filter).
Pairs that pass are verified in full. Words outside all templates cannot add to
an overlap and are left out of the sets.

Phrases are templates too, with a threshold of one; a verified block is then
searched for the places where the words stand consecutively.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import table

#: What separates words once A-Z are lower-cased: every ASCII character but 0-9 and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIDE, BLOCK = 128, 256
THRESHOLD = 0.8

# Phrases and labels, then public license notices as they are commonly printed, with labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
NOTICES = {
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl-3-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-2-line": "licensed under the apache license version 2 0",
    "gpl-3-line": "this work is licensed under the gnu general public license version 3",
    "mit-line": "released under the mit license",
    "cc-by-nc-line": "licensed under cc by nc 4 0",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    needed: int  # distinct words that a block must contain
    phrase: bool

    @property
    def distinct(self) -> set[str]:
        return set(self.words)


def templates_of(phrases: dict[str, str], notices: dict[str, str], threshold: float) -> list[Template]:
    made = [Template(label, tuple(text.split()), len(set(text.split())), True) for text, label in phrases.items()]
    for label, text in notices.items():
        words = tuple(text.split())
        made.append(Template(label, words, math.ceil(threshold * len(set(words))), False))
    if any(not t.words or len(t.words) > BLOCK - STRIDE for t in made):
        raise ValueError(f"a template has 1 to {BLOCK - STRIDE} words")
    return made


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values]) if values else F.array().cast("array<string>")


def _blocks(words: str) -> Column:
    count = F.greatest(F.ceil(F.size(words) / F.lit(STRIDE)), F.lit(1)).cast("int")
    cut = lambda i: F.struct((i * STRIDE).alias("start"), F.slice(words, i * STRIDE + 1, BLOCK).alias("words"))
    return F.transform(F.sequence(F.lit(0), count - 1), cut)


def frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many blocks of docs each word of the templates' vocabulary stands; one row per such word comes back."""
    rows = docs.select(words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    blocks = rows.select(F.explode(_blocks("words")).alias("block"))
    found = blocks.select(F.explode(F.array_intersect(_strings(vocabulary), "block.words")).alias("word"))
    counted = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {word: counted.get(word, 0) for word in vocabulary}


def _index(spark: SparkSession, templates: list[Template], order: dict[str, int]) -> tuple[DataFrame, list[str]]:
    """The templates' prefixes, one row per word and template, and the words themselves in the global order."""
    rows = []
    for t in templates:
        ranked = sorted(t.distinct, key=order.__getitem__)
        for place, word in enumerate(ranked[: len(ranked) - t.needed + 1]):
            rows.append(
                F.struct(
                    F.lit(word).alias("token"), F.lit(t.label).alias("label"), F.lit(t.phrase).alias("phrase"), F.lit(place).alias("place"),
                    F.lit(t.needed).alias("needed"), _strings(ranked).alias("template"), _strings(list(t.words)).alias("sequence"),
                )
            )
    prefix = {word for t in templates for word in sorted(t.distinct, key=order.__getitem__)[: len(t.distinct) - t.needed + 1]}
    return spark.range(1).select(F.inline(F.array(*rows))), sorted(prefix, key=order.__getitem__)


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks, first_block.

    n_base counts the places of all phrases, first_word and last_word are the smallest and largest of their starts
    (null without any). labels has the phrases' and notices' labels, score the largest containment found, 0 without
    any; n_blocks and first_block tell where notices stand (blocks start every STRIDE words). Null and empty texts have
    no words. Ids, null ones included, are only passed on; repeated rows each get their row. Other columns are not
    read. An empty table gives an empty result.
    """
    spark, templates = docs.sparkSession, templates_of(phrases, notices, threshold)
    vocabulary = sorted(set().union(*[t.distinct for t in templates]))
    counted = frequencies(docs, vocabulary, text_col)
    ranked = sorted(vocabulary, key=lambda word: (counted[word], word))
    index, prefix = _index(spark, templates, {word: rank for rank, word in enumerate(ranked)})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    near = F.filter(_blocks("words"), lambda b: F.arrays_overlap(b["words"], _strings(prefix)))
    rows = rows.select("row", "id", F.size("words").cast("long").alias("n_words"), near.alias("blocks"))
    rows = rows.select("row", "id", "n_words", F.explode_outer("blocks").alias("block"))
    rows = rows.withColumn("tokens", F.array_intersect(_strings(ranked), "block.words"))
    rows = rows.withColumn("token", F.explode_outer(F.array_intersect(_strings(prefix), "tokens")))

    at, size, needed = F.array_position("tokens", F.col("token")) - 1, F.size("tokens"), F.col("needed")
    left = F.least(F.size("template") - F.col("place"), size - at)
    may = (size >= needed) & (left >= needed)
    rows = rows.join(F.broadcast(index), "token", "left")
    shared = F.array_intersect("template", "tokens")
    rows = rows.withColumn("shared", F.when(may, shared))
    # a pair shares several prefix words, but only one is its first
    met = (F.size("shared") >= needed) & (F.element_at("shared", 1) == F.col("token"))
    length = F.size("sequence")
    starts = F.filter(
        F.sequence(F.lit(0), F.least(F.size("block.words"), F.lit(STRIDE)) - 1),
        lambda i: F.slice("block.words", i + 1, length) == F.col("sequence"),
    )
    rows = rows.withColumn("met", F.coalesce(met, F.lit(False)))
    rows = rows.withColumn("places", F.when(F.col("met") & F.col("phrase"), F.transform(starts, lambda i: i + F.col("block.start"))))
    base = F.coalesce(F.size("places") > 0, F.lit(False))
    notice = F.col("met") & ~F.col("phrase")
    label = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    share = F.when(base, F.lit(1.0)).when(notice, F.size("shared") / F.size("template"))
    found = rows.groupBy("row", "id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.size("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.element_at("places", 1))).cast("long").alias("first_word"),
        F.max(F.when(base, F.element_at("places", -1))).cast("long").alias("last_word"),
        label(base).alias("base_labels"),
        label(base | notice).alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
        F.count(F.when(notice, F.lit(1))).alias("n_blocks"),
        F.min(F.when(notice, F.col("block.start"))).cast("long").alias("first_block"),
    )
    return found.drop("row")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _oracle() -> str:
    def sql_list(words: object) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    made = templates_of(PHRASES, NOTICES, THRESHOLD)
    notices = ", ".join(f"('{t.label}', {sql_list(sorted(t.distinct))}, {t.needed})" for t in made if not t.phrase)
    phrases = ", ".join(f"('{t.label}', {sql_list(t.words)})" for t in made if t.phrase)
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
notice(label, words, needed) AS (VALUES {notices}),
phrase(label, words) AS (VALUES {phrases}),
place AS (
  SELECT rid, label, unnest(list_filter(range(0, len(d.words)), lambda i: d.words[i + 1 : i + len(p.words)] = p.words)) AS spot FROM docs d, phrase p),
block AS (SELECT rid, i * {STRIDE} AS start, list_distinct(words[i * {STRIDE} + 1 : i * {STRIDE} + {BLOCK}]) AS words
  FROM (SELECT rid, words, unnest(range(0, greatest(((len(words) + {STRIDE - 1}) // {STRIDE}), 1))) AS i FROM docs)),
met AS (
  SELECT rid, label, start, len(list_intersect(b.words, n.words))::DOUBLE / len(n.words) AS share
  FROM block b, notice n WHERE len(list_intersect(b.words, n.words)) >= n.needed),
base AS (
  SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM place GROUP BY rid),
labelled AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT rid, label, share FROM met UNION ALL SELECT rid, label, 1.0::DOUBLE FROM place) GROUP BY rid),
blocks AS (SELECT rid, count(*) AS n_blocks, min(start) AS first_block FROM met GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score,
       coalesce(n_blocks, 0)::BIGINT AS n_blocks, first_block::BIGINT AS first_block
FROM docs LEFT JOIN base USING (rid) LEFT JOIN labelled USING (rid) LEFT JOIN blocks USING (rid)"""


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES = {"op2_license_scan": _oracle()}
