"""License scans by diagonal voting.

The rolling word k-grams of every text are hashed and joined to the template positions that have the
same hash and the same words. A hit at word w of the text and word p of the template votes for diagonal
w - p: an exact copy of a phrase puts all its votes on one diagonal, an insertion or deletion moves the
later votes to a neighbouring one. So diagonals are merged with those that follow, as far apart as words
may be put in or left out. A merged span is verified: its words are aligned with the template's in order,
and it stands when the words so matched reach the template's share. The template table is fixed, a few
hundred rows of literals, and broadcast; a text is split into words once, and only its hits and one slim
row leave the task that read it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .histogram_sort import written

GRAM = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything in ASCII that is no digit or letter once A-Z are lower case.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class LicenseTemplate:
    """A phrase; ``share`` is the part of its words that a span must match in order, 1.0 for exact places.

    As many words as may be left out, and no more, may be put in.
    """

    label: str
    text: str
    share: float = 1.0
    base: bool = False


#: The phrases that must be found exactly.
BASE_PHRASES = (
    LicenseTemplate("mit", "under the mit license", base=True),
    LicenseTemplate("apache-2", "apache license version 2", base=True),
    LicenseTemplate("cc-by-nc", "cc by nc", base=True),
)
#: Characteristic passages of public licenses.
NOTICES = (
    LicenseTemplate("agpl-3", "licensed under the gnu affero general public license version 3", 1.0),
    LicenseTemplate("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 0.7),
    LicenseTemplate("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.7),
    LicenseTemplate("cc-by", "licensed under a creative commons attribution 4 0 international license", 1.0),
    LicenseTemplate("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", 1.0),
    LicenseTemplate("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", 0.7),
    LicenseTemplate("gpl", "licensed under the gnu general public license", 1.0),
    LicenseTemplate("gpl-2", "licensed under the gnu general public license version 2", 1.0),
    LicenseTemplate("gpl-3", "licensed under the gnu general public license version 3", 1.0),
    LicenseTemplate("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.7),
    LicenseTemplate("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.7),
    LicenseTemplate("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.8),
    LicenseTemplate("proprietary", "all rights reserved no part of this publication may be reproduced", 0.9),
    LicenseTemplate("unlicense", "this is free and unencumbered software released into the public domain", 0.8),
)


def words_of(text: Column) -> Column:
    """Words in lower case; null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), lambda w: w != "")


def grams_of(words: Column, k: int = GRAM) -> Column:
    """An array of each k consecutive words, by position from 0."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.slice(words, i, F.lit(k)))).otherwise(F.array().cast("array<array<string>>"))


def gram_hash(words: Column, at: Column, k: int = GRAM) -> Column:
    return F.xxhash64(*[F.get(words, at + d) for d in range(k)])


def template_table(spark, templates: tuple[LicenseTemplate, ...], k: int = GRAM) -> DataFrame:
    """hash, gram, template, at, size, room: the templates' positions; ``room`` is how many words may be put in."""
    if any(len(t.text.split()) < k for t in templates):
        raise ValueError(f"templates need {k} words")
    rows = [F.struct(F.lit(n).alias("template"), F.array(*map(F.lit, t.text.split())).alias("words"), F.lit(len(t.text.split())).alias("size"), F.lit(room_of(t)).alias("room")) for n, t in enumerate(templates)]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    placed = table.select("template", "size", "room", F.posexplode(grams_of(F.col("words"), k)).alias("at", "gram"))
    return placed.withColumn("hash", gram_hash(F.col("gram"), F.lit(0), k))


def room_of(template: LicenseTemplate) -> int:
    """Words that may be put in: as many as may be missing."""
    size = len(template.text.split())
    return size - math.ceil(template.share * size - 1e-9)


def aligned(pairs: Column) -> Column:
    """How many of the pairs (word of the text, word of the template) can be taken with both rising: the words matched in order.

    A fold keeps, for each number of matches, the least template word that they can end with.
    """
    ordered = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["word"].alias("word"), (-p["at"]).alias("back")))))
    kept = lambda ends, at: F.size(F.filter(ends, lambda e: e < at))
    ends = F.aggregate(ordered, F.array().cast("array<int>"), lambda ends, p: F.concat(F.slice(ends, F.lit(1), kept(ends, -p["back"])), F.array(-p["back"]), F.slice(ends, kept(ends, -p["back"]) + 2, F.size(ends))))
    return F.size(ends)


def find_spans(hits: DataFrame, keys: list[str], templates: tuple[LicenseTemplate, ...], k: int = GRAM) -> DataFrame:
    """keys, template, first, last (words of the text, from 0), coverage (0 to 1). ``hits`` has keys, template, word, at, size, room.

    A whole template on one diagonal is a span of its own. Elsewhere the diagonals from each one on, ``room`` of them, are
    merged and verified; of merged spans that share diagonals the one that matches most words stays, and the first of those.
    """
    votes = hits.groupBy(*keys, "template", "size", "room", (F.col("word") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    full = F.size("ats") == F.col("size") - (k - 1)
    exact = votes.where(full).select(*keys, "template", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("coverage"))

    own = Window.partitionBy(*keys, "template").orderBy("diagonal")
    rooms = max(map(room_of, templates))
    # Word pairs of the diagonals in reach; a diagonal beyond the template's own room is left out again.
    near = votes.where("room > 0").withColumn("band", F.collect_list(F.struct("diagonal", "ats")).over(own.rangeBetween(0, rooms)))
    words = F.flatten(F.transform(F.filter("band", lambda d: d["diagonal"] <= F.col("diagonal") + F.col("room")), lambda d: F.flatten(F.transform(d["ats"], lambda at: F.transform(F.sequence(at, at + (k - 1)), lambda i: F.struct((d["diagonal"] + i).alias("word"), i.alias("at")))))))
    near = near.select(*keys, "template", "size", "room", "diagonal", full.alias("full"), words.alias("pairs"))
    least = F.col("size") - F.col("room")
    near = near.where(F.size(F.array_distinct(F.transform("pairs", lambda p: p["at"]))) >= least).withColumn("matched", aligned(F.col("pairs"))).where(F.col("matched") >= least)
    # Of spans that share diagonals with a better one, none stays; a whole template takes those around it.
    rank = F.struct("matched", F.col("full").cast("int"), -F.col("diagonal"))
    near = near.withColumn("best", F.max(rank).over(own.rangeBetween(-rooms, rooms))).where((rank == F.col("best")) & ~F.col("full"))
    merged = near.select(*keys, "template", F.array_min(F.transform("pairs", lambda p: p["word"])).alias("first"), F.array_max(F.transform("pairs", lambda p: p["word"])).alias("last"), (F.col("matched") / F.col("size")).alias("coverage"))
    return exact.unionByName(merged)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[LicenseTemplate, ...] = BASE_PHRASES + NOTICES, k: int = GRAM) -> DataFrame:
    """doc_id, n_words, spans (array of struct(label, first, last, base, coverage)), n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest start. Labels are
    distinct and sorted. ``score`` is the best coverage, 0 without a span. Null and empty texts have no words and no
    spans; rows with a null id, and rows that agree in id and text, get the same result each; other columns, whatever their
    names, are not carried along. An empty table gives no rows. A text may be of any length; its hits with one template
    are one group, as many as the text has.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates, k)
    # At most a few hundred hashes: texts' other grams never become rows.
    known = [r[0] for r in table.select("hash").distinct().collect()]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("print"), F.array(words_of(F.col(text_col))).alias("words"))

    def scanned(words: Column) -> Column:
        places = F.when(F.size(words) >= k, F.filter(F.sequence(F.lit(0), F.size(words) - k), lambda i: gram_hash(words, i, k).isin(*known))).otherwise(F.array().cast("array<int>"))
        row = F.struct(F.lit(1).alias("rows"), F.size(words).cast("long").alias("n_words"), F.lit(None).cast("int").alias("word"), F.lit(None).cast("array<string>").alias("gram"))
        found = F.transform(places, lambda i: F.struct(F.lit(0).alias("rows"), F.lit(0).cast("long").alias("n_words"), i.alias("word"), F.slice(words, i + 1, F.lit(k)).alias("gram")))
        return F.concat(F.array(row), found)

    # A row for the text, then one for each place whose words may be a template's.
    scan = texts.select("id", "print", F.inline(F.get(F.transform("words", scanned), F.lit(0))))
    keys = ["id", "print"]
    met = scan.withColumn("hash", F.when(F.col("word").isNotNull(), gram_hash(F.col("gram"), F.lit(0), k))).join(F.broadcast(table), ["hash", "gram"], "left")
    # Repeated rows make the same hits: one group of rows, as many results as there are rows.
    counted = met.groupBy(*keys, "template", "size", "room", "word", "at").agg(F.sum("rows").alias("rows"), F.max("n_words").alias("n_words"))
    counted = written(counted, "license-hits")
    spans = find_spans(counted.where("template is not null"), keys, templates, k)

    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    base = F.col("template").isin([n for n, t in enumerate(templates) if t.base])
    span = F.struct(label.alias("label"), F.col("first"), F.col("last"), base.alias("base"), F.col("coverage"))
    none = F.lit(None)
    either = counted.where("template is null").select(*keys, "rows", "n_words", none.cast("struct<label:string,first:int,last:int,base:boolean,coverage:double>").alias("span"))
    either = either.unionByName(spans.select(*keys, F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_words"), span.alias("span")))
    found = either.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_list("span")).alias("spans"))
    found = found.select("id", "n_words", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"))
    base_spans = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base_spans, lambda s: s["first"])
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda s: s["label"]))), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "spans",
        F.size(base_spans).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base_spans).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
