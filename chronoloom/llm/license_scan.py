"""License scans: a positional index of rare licence words. DataFrame functions only.

The content words of all templates are the index's vocabulary. Every file's words in that vocabulary are kept with
their positions. A word's IDF is counted over all files; each template is indexed by its ANCHORS highest-IDF words. A
file looks its words up in the postings (template, position); a lookup's start is ``position in file - position in
template``. A template's place is the start on which every word of its mandatory key phrase agrees. It is found there if
enough of its anchors start within SHIFT words of it, so that words put in or left out between them do no harm. Short
phrases are templates whose every word is mandatory, so each of their places is found.

Edge cases: null and empty texts have no words and no labels, score 0. Very long texts are read whole. Words of equal IDF rank by their place. Repeated rows are each answered. Empty tables
give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, tidy

# Phrases that name a licence.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Notices of common licences, short and in the published wording, with the key phrase that must stand in a found place.
TEMPLATES = {
    "mit": [
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "permission hereby granted"),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission hereby granted"),
    ],
    "apache": [
        ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license"),
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license"),
    ],
    "gpl": [
        ("this work is licensed under the gnu general public license version 3", "general public license"),
        ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ],
    "lgpl": [
        ("licensed under the gnu lesser general public license", "lesser general public license"),
        ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ],
    "bsd": [("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution source binary forms")],
    "mpl": [
        ("this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
        ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ],
    "cc": [
        ("licensed under creative commons attribution license", "creative commons"),
        ("this work is licensed under a creative commons attribution 4 0 international license", "creative commons"),
    ],
    "cc-by-sa": [("this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike")],
    "cc0": [("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright related neighboring rights")],
    "agpl": [
        ("licensed under the gnu affero general public license", "affero general public license"),
        ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "purpose with or without fee hereby granted")],
    "zlib": [("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "including commercial applications alter redistribute freely")],
    "boost": [("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person organization obtaining copy")],
    "epl": [("this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license")],
    "unlicense": [("this is free and unencumbered software released into the public domain", "free unencumbered software released")],
    "cc-by-nc": [
        ("licensed under cc by nc 4 0", "licensed cc nc"),
        ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ],
}
# Words too common to index.
COMMON = ("a", "all", "and", "any", "are", "as", "at", "be", "by", "can", "except", "following", "for", "form", "forms", "file", "files", "if", "in", "is", "it", "may", "met", "not", "of", "one", "or", "subject", "that", "the", "this", "to", "under", "use", "v", "was", "with", "without", "you", "0", "2", "3", "4")
#: Highest-IDF words by which a template is found, and the share of them that must agree.
ANCHORS, AGREE = 6, 0.75
#: Words by which an anchor of a notice may stand off its place, counted from the key phrase.
SHIFT = 8


def _places(words: list[str], key: str) -> set[int]:
    """Where the words of a key phrase stand in a template, one after another."""
    found, at = [], 0
    for w in key.split():
        at = words.index(w, at)
        found.append(at)
    return set(found)


def index_rows() -> list[tuple[str, str, int, str, str, bool]]:
    """(template, label, position, word, kind, must): content words of phrases and notices by their places."""
    rows = []
    for phrase, label in PHRASES.items():
        rows += [(f"phrase:{phrase}", label, i, w, "phrase", True) for i, w in enumerate(phrase.split())]
    for label, texts in TEMPLATES.items():
        for n, (text, key) in enumerate(texts):
            words = text.split()
            must = _places(words, key)
            rows += [(f"notice:{label}" + f":{n}" * (n > 0), label, i, w, "notice", i in must) for i, w in enumerate(words) if w not in COMMON or i in must]
    return rows


def _index(spark: SparkSession) -> DataFrame:
    listed = ", ".join(f"('{t}', '{lab}', {i}, '{w}', '{k}', {m})" for t, lab, i, w, k, m in index_rows())
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t(template, label, position, word, kind, must)")


def vocabulary() -> list[str]:
    words = {w for p in PHRASES for w in p.split()} | {w for texts in TEMPLATES.values() for text, key in texts for w in [*text.split(), *key.split()] if w not in COMMON or w in key.split()}
    return sorted(words)


@tidy
def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) of every document.

    places: array of (label, template, first word, share of its anchors that agree).
    """
    spark = docs.sparkSession
    vocab = vocabulary()
    words = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    cut = docs.select(F.col(id_col).alias("doc_id"), words.alias("w"))
    cut = cut.withColumn("w", F.when(F.element_at("w", 1) == "", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))).otherwise(F.col("w")))
    cut = cut.withColumn("w", F.when((F.size("w") > 0) & (F.element_at("w", -1) == ""), F.slice("w", 1, F.size("w") - 1)).otherwise(F.col("w")))
    least, most = min(map(len, vocab)), max(map(len, vocab))
    # a hashed lookup of every short word; only A-Z are lower-cased, which is told apart in the few words that are found
    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    near = F.filter(places, lambda i: F.octet_length(F.col("w")[i]).between(least, most) & F.lower(F.col("w")[i]).isin(vocab))
    near = F.transform(near, lambda i: F.struct(i.alias("at"), F.translate(F.col("w")[i], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word")))
    near = F.filter(near, lambda x: x["word"].isin(vocab))
    files = materialize(cut.select(F.monotonically_increasing_id().alias("file"), "doc_id", F.size("w").cast("long").alias("n_words"), near.alias("hits")), "licence_words")

    hits = files.where(F.size("hits") > 0).select("file", F.explode("hits").alias("x")).select("file", "x.at", "x.word")
    index = _index(spark)
    df = files.where(F.size("hits") > 0).select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = index.select("word").distinct().join(df, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("template").orderBy("df", "position"))
    postings = index.join(idf, "word").withColumn("rank", rank).where(F.col("must") | (F.col("rank") <= ANCHORS))
    template = Window.partitionBy("template")
    postings = postings.withColumns({"anchors": F.count("*").over(template), "musts": F.count(F.when(F.col("must"), 1)).over(template)})
    postings = postings.select("template", "label", "kind", "word", "position", "must", "anchors", "musts")
    # at most one row for each word of the templates above
    votes = hits.join(F.broadcast(postings), "word").withColumn("start", F.col("at") - F.col("position"))
    exact = votes.where("must").groupBy("file", "template", "label", "kind", "start", "anchors", "musts").agg(F.count("*").alias("verified")).where("verified = musts").drop("verified")
    base = exact.where("kind = 'phrase'").select("file", "template", "label", "kind", "start", F.lit(1.0).alias("share"))
    # anchors near the place that the key phrase gives them: those of its bucket of places and of both neighbours
    bucket = F.floor(F.col("start") / SHIFT)
    keyed = exact.where("kind = 'notice'").select("*", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    around = votes.where("kind = 'notice'").select("file", "template", bucket.alias("bucket"), F.col("start").alias("off"), "position")
    # a key phrase is its own anchor, so every key has rows here; files have a bounded number of words in three buckets
    agree = keyed.join(around, ["file", "template", "bucket"]).where(F.abs(F.col("off") - F.col("start")) <= SHIFT)
    agree = agree.groupBy("file", "template", "label", "kind", "start", "anchors").agg(F.count_distinct("position").alias("agree")).where(F.col("agree") >= AGREE * F.col("anchors"))
    found = base.union(agree.select("file", "template", "label", "kind", "start", (F.col("agree") / F.col("anchors")).alias("share")))
    is_base = F.col("kind") == "phrase"
    by_file = found.groupBy("file").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
        F.collect_set(F.struct("label", "template", F.col("start").alias("first"), "share")).alias("places"),
    )
    out = files.select("file", "doc_id", "n_words").join(by_file, "file", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "places",
    )
