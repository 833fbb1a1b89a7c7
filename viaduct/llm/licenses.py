"""License scan by diagonal voting, in DataFrame functions only.

Method. The hashes of all rolling runs of ``K`` words of every text are looked up among the runs of the license
templates, and those that are found are joined with them (templates are constants of this module, so set and broadcast have a fixed size). A hit at word p of the text and
word q of the template votes for the offset diagonal p - q. Votes are grouped by text, template and diagonal, and
diagonals at most ``NEAR`` apart are merged, which bridges inserted and deleted words. Spans are verified on
the words themselves: the template's words that stand on the merged diagonals, as a share of the
template, must reach ``LEAST``.

Besides, phrases are found word by word (``base``), and a phrase gives its label for certain.

A text is split into words once. A hit carries the words around it, as many as the longest template has on each side, never the
text; which template words stand on a diagonal is a bit mask. So a text of any length, or one that repeats a
template any number of times, costs a small row a hit. Hits exist only where a template's words stand, so a common word or hot
source gathers nothing; texts are never shuffled.

Nulls: a null text has no words. Rows with the same id and text count as one document, and each of them is returned. An empty table gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.session import materialize

K, NEAR, LEAST = 3, 3, 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Label of each phrase and template: openings of public licenses, fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
}


def words_of(text: Column) -> Column:
    """Lower-cased words; empty strings at the ends of the split are dropped."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def run_hash(words: Column, i: Column, k: int = K) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(k)])


def places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    room = F.size(words) - len(parts)
    here = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + j) == p for j, p in enumerate(parts)])
    return F.when(room >= 0, F.filter(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def template_runs(spark, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``template, label, template_words, at, run``: all runs of the templates."""
    rows = [(n, label, text.split(" ")) for n, (text, label) in enumerate(templates.items())]
    if any(not K <= len(words) < 64 for _, _, words in rows):
        raise ValueError(f"a template has {K} to 63 words")
    frame = spark.createDataFrame(rows, "template int, label string, template_words array<string>")
    places = F.sequence(F.lit(0), F.size("template_words") - K)
    return frame.select("*", F.explode(places).alias("at")).select("*", run_hash(F.col("template_words"), F.col("at")).alias("run"))


def words_and_hits(docs: DataFrame, id_col: str, text_col: str, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """``doc_id, text_hash, n_words``, ``p0, p1, ..``: the places of each phrase, and ``hits``: ``place, run, around`` of each run that a template has.

    ``around`` are the words from ``reach`` before the place on, the longest template's length.
    """
    spark = docs.sparkSession
    runs = [r[0] for r in template_runs(spark, templates).select("run").distinct().collect()]  # constants
    reach = max((len(x.split(" ")) for x in templates), default=0)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("w"))
    # the generator keeps the optimizer from splitting a text again for each use
    rows = rows.select("doc_id", "text_hash", F.inline(F.array(F.struct(F.col("w").alias("words")))))
    words = F.col("words")
    empty = F.array().cast("array<int>")
    last_words = {p.split(" ")[-1] for p in phrases}
    may = reduce(lambda a, b: a | b, [F.array_contains(words, w) for w in sorted(last_words)], F.lit(False))
    at = [F.when(may, places(words, p)).otherwise(empty).alias(f"p{i}") for i, p in enumerate(phrases)]
    every = F.transform(words, lambda w, i: F.struct(i.alias("place"), run_hash(words, i).alias("run")))
    met = F.filter(every, lambda x: x["run"].isin(runs) & (x["place"] <= F.size(words) - K)) if runs else F.filter(every, lambda x: F.lit(False))
    # a slice may not begin before the first word
    around = lambda p: F.slice(words, F.greatest(p - reach, F.lit(0)) + 1, 2 * reach)
    hits = F.transform(met, lambda x: F.struct(x["place"].alias("place"), x["run"].alias("run"), around(x["place"]).alias("around")))
    return rows.select("doc_id", "text_hash", F.size(words).cast("bigint").alias("n_words"), *at, hits.alias("hits"))


def _spans(rows: DataFrame, templates: dict[str, str]) -> DataFrame:
    reach = max((len(x.split(" ")) for x in templates), default=0)
    hits = rows.select("doc_id", "text_hash", F.inline("hits")).join(F.broadcast(template_runs(rows.sparkSession, templates)), "run")
    hits = hits.withColumn("diagonal", F.col("place") - F.col("at"))
    # template words that stand on this diagonal, by comparison of the words: a bit each
    begin = F.greatest(F.col("place") - reach, F.lit(0))
    here = lambda q: F.get("around", F.when(q + F.col("diagonal") >= begin, q + F.col("diagonal") - begin)) == F.get("template_words", q)
    bits = F.array(*[F.lit(1 << q).cast("bigint") for q in range(reach)])
    places = F.sequence(F.lit(0), F.size("template_words") - 1)
    mask = F.aggregate(places, F.lit(0).cast("bigint"), lambda have, q: have.bitwiseOR(F.when(here(q), F.get(bits, q)).otherwise(F.lit(0).cast("bigint"))))
    of = ["doc_id", "text_hash", "template", "label"]
    lines = hits.select(*of, "diagonal", F.size("template_words").alias("n"), mask.alias("mask")).groupBy(*of, "n", "diagonal").agg(F.max("mask").alias("mask"))
    order = Window.partitionBy(*of).orderBy("diagonal")
    lines = lines.withColumn("fresh", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True)))
    lines = lines.withColumn("island", F.sum(F.col("fresh").cast("int")).over(order))
    low, high = F.bit_count(F.col("mask").bitwiseAND(-F.col("mask")) - 1), F.length(F.bin("mask")) - 1
    found = lines.groupBy(*of, "n", "island").agg(F.min(F.col("diagonal") + low).alias("first_word"), (F.max(F.col("diagonal") + high) + 1).alias("end_word"), F.bit_or("mask").alias("mask"))
    share = F.bit_count("mask") / F.col("n")
    return found.select("doc_id", "text_hash", "label", "template", "first_word", "end_word", share.alias("share")).where(F.col("share") >= LEAST)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, text_hash, label, template, first_word, end_word, share``: the verified spans."""
    return _spans(words_and_hits(docs, id_col, text_col, {}, templates), templates)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per document ``n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    rows = materialize(words_and_hits(docs, id_col, text_col, phrases, templates), "license-hits")
    found = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))
    base = rows.select("doc_id", "text_hash", "n_words", found.alias("at"), labels.alias("own"))
    extra = _spans(rows.where(F.size("hits") > 0), templates).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    extra = extra.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"), "more", "share")
    joined = base.join(extra, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash")), "left")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("at").cast("bigint").alias("n_base"),
        F.array_min("at").cast("bigint").alias("first_word"),
        F.array_max("at").cast("bigint").alias("last_word"),
        text(F.col("own")).alias("base_labels"),
        text(F.concat("own", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
