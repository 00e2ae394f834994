"""License scans: diagonal voting of word k-grams against short template texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of one hashed gram. No template may be shorter.
K = 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Found only word for word, at every place; else by the share of its grams in a span.
    exact: bool = False


#: The phrases that always count, and openings of public licence notices.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("mit", "released under the terms of the mit license"),
    Template("apache-2", "licensed under the terms of the apache license version 2 0"),
)


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased; digits, letters and all beyond ASCII."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    clean = F.regexp_replace(low, r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+$", "")
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, least: float = 0.6, drift: int = 4) -> DataFrame:
    """Licence labels of every text, one row for each row of docs.

    All k-grams of words meet the templates' grams in a join whose small side is the fixed template list; words are
    compared, too, so a hash alone is never a hit. Hits are summed by diagonal (word place less template place) within
    each row and template. Exact templates count where one diagonal has all grams. For the others, diagonals at most
    drift apart whose hits lie within a template's length (and drift) are one span, which stands if it has at least a
    share least of the grams. score is the greatest such share over the spans that stand, 1 for exact ones, else 0.

    Returns rid, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (array of
    struct<label, first, last, share>). Null or wordless text: no hits. Repeated rows each get their row. Empty table: no row.
    """
    spark = docs.sparkSession
    grams = []
    for t, x in enumerate(templates):
        w = x.text.split()
        if len(w) < K:
            raise ValueError(f"a template needs {K} words: {x.text}")
        grams += [(t, x.label, x.exact, len(w), p, *w[p : p + K]) for p in range(len(w) - K + 1)]
    parts = ", ".join(f"w{i} string" for i in range(K))
    known = spark.createDataFrame(grams, f"t int, label string, exact boolean, size int, p int, {parts}").coalesce(1)
    known = known.withColumn("h", F.xxhash64(*(f"w{i}" for i in range(K))))

    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("ws"))
    # place -1 stands for the row itself, so that one pass over the texts gives both rows and hits
    each = own.select("rid", "doc_id", "ws", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("ws") - K, F.lit(-1)))).alias("i"))
    gram = F.when(F.col("i") >= 0, F.xxhash64(*(F.get("ws", F.col("i") + j) for j in range(K))))
    keyed = each.withColumn("g", gram)
    same = F.col("g") == F.col("h")
    for j in range(K):
        same = same & (F.get("ws", F.col("i") + j) == F.col(f"w{j}"))
    hits = keyed.join(F.broadcast(known), same, "left").where("i < 0 or t is not null")
    diagonals = hits.groupBy("rid", "doc_id", F.when(F.col("i") < 0, F.size("ws")).alias("n_words"), "t", "label", "exact", "size", (F.col("i") - F.col("p")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("i").alias("first"), F.max("i").alias("last"), F.collect_set("p").alias("places")
    )
    # neighbouring diagonals of one row and template, walked in order of place
    w = Window.partitionBy("rid", "t").orderBy("first", "diagonal")
    before = F.lag("last").over(w)
    new = before.isNull() | (F.col("first") - before > F.col("size") + drift) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) > drift) | F.col("exact")
    grouped = diagonals.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = grouped.groupBy("rid", "doc_id", "t", "label", "exact", "size", "span").agg(
        F.max("n_words").alias("n_words"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / (F.first("size") - (K - 1))).alias("share"),
    )
    stands = F.col("t").isNotNull() & F.when(F.col("exact"), F.col("share") == 1).otherwise(F.col("share") >= least)
    base = stands & F.col("exact")
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    span = F.struct("label", "first", "last", "share")
    return spans.groupBy("rid", "doc_id").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(stands).alias("labels"),
        F.coalesce(F.max(F.when(stands, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(stands, span))).alias("spans"),
    )
