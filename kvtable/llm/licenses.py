"""License scans with a positional rare-token index over license templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, PLAIN_GAP, PLAIN_WORD, UPPER, ascii_lower, table

GAP_CHARACTERS = "".join(chr(c) for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))

#: Phrases that are counted at every place, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Label and passage of each license text, as plain words; the words in brackets are its mandatory key phrase.
#: Long licenses stand as one template a passage: a word more or less shifts the places behind it in that passage only.
TEMPLATES = [
    ("agpl", "under the terms of the gnu [affero general public license]"),
    ("agpl", "you can redistribute it and or modify it under the terms of the [gnu affero general public license as published by the free software foundation]"),
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    ("apache-2.0", "[you may not use this file except in compliance with the license] you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software [distributed under the license is distributed on an as is basis] without warranties or conditions of any kind either express or implied"),
    ("as-is", "[the software is provided as is without warranty of any kind] express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("as-is", "[in no event shall the authors or copyright holders be liable] for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted"),
    ("bsd", "[redistributions of source code must retain the above copyright notice] this list of conditions and the following disclaimer"),
    ("bsd", "[redistributions in binary form must reproduce the above copyright notice] this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "[may be used to endorse or promote products derived from this software] without specific prior written permission"),
    ("bsl-1.0", "distributed under the [boost software license version 1 0]"),
    ("cc-by", "creative commons [attribution 4 0 international license]"),
    ("cc-by-nc", "licensed under [cc by nc] 4 0"),
    ("cc-by-nc", "creative commons [attribution noncommercial] 4 0 international license"),
    ("cc-by-nd", "licensed under [cc by nd] 4 0"),
    ("cc-by-nd", "creative commons [attribution noderivatives] 4 0 international license"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("cc-by-sa", "creative commons [attribution sharealike] 4 0 international license"),
    ("cc0", "dedicated under [cc0 1 0] universal"),
    ("cc0", "to the extent possible under law the author has [waived all copyright and related or neighboring rights] to this work"),
    ("epl-2.0", "made available under the terms of the [eclipse public license 2 0]"),
    ("gpl-2.0", "licensed under the gnu [general public license version 2]"),
    ("gpl-2.0", "the terms of the [gnu general public license as published by the free software foundation either version 2] of the license or at your option any later version"),
    ("gpl-3.0", "licensed under the gnu [general public license version 3]"),
    ("gpl-3.0", "the terms of the [gnu general public license as published by the free software foundation either version 3] of the license or at your option any later version"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu [lesser general public license]"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the [gnu lesser general public license as published by the free software foundation]"),
    ("mit", "released under the [mit license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the [rights to use copy modify merge publish distribute sublicense and or sell] copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mpl-2.0", "subject to the terms of the [mozilla public license] v 2 0"),
    ("mpl-2.0", "[if a copy of the mpl was not distributed with this file] you can obtain one at https mozilla org mpl 2 0"),
    ("unlicense", "this is free and [unencumbered software] released into the public domain"),
    ("unlicense", "[anyone is free to copy modify publish use compile sell or distribute this software] either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "[in no event will the authors be held liable for any damages] arising from the use of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to [alter it and redistribute it freely]"),
]


def words_of(text: Column) -> Column:
    """The text's words as an array; empty for none."""
    trimmed = F.btrim(ascii_lower(text), F.lit(GAP_CHARACTERS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, PLAIN_GAP))


def parse(template: str) -> tuple[list[str], list[int]]:
    """Words of a template, and the places of its key phrase."""
    words, key, inside = [], [], False
    for token in re.findall(r"\[|\]|[^\s\[\]]+", template):
        if token in "[]":
            inside = token == "["
        else:
            if inside:
                key.append(len(words))
            words.append(token)
    return words, key


def listed(base: list[tuple[str, str]], templates: list[tuple[str, str]], share: float) -> list[tuple[str, bool, list[str], list[int], int]]:
    """Label, whether it is a base phrase, words, places of the key phrase, and how many words must stand, of every template."""
    rows = [(label, True, *parse(f"[{phrase}]")) for phrase, label in base] + [(label, False, *parse(t)) for label, t in templates]
    return [(label, is_base, words, key, int(max(len(key), -(-len(words) * share // 1)))) for label, is_base, words, key in rows]


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: list[tuple[str, str]] = BASE,
    templates: list[tuple[str, str]] = TEMPLATES,
    share: float = 0.6,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, found: array of (label, start, n_words, is_base, score), sorted.

    The license vocabulary's document frequencies are counted over all documents (an aggregate of
    one row a word). Each template is indexed under the word of its key phrase with the highest IDF
    (other words may be missing). Of each file's license words those are looked up that are the
    highest-IDF one of a template whose whole key vocabulary the file has; each posting gives the place
    where the template would start, and the template's words are intersected at their relative
    positions. A place counts if the whole key phrase stands there and at least ``share`` of all
    the template's words; base phrases are templates that are key phrase throughout. What is not looked up
    cannot hold a key phrase, so nothing is lost. Two scans of the text, no shuffle of it, and no work for
    files without such a word.

    Null text counts as empty: no words, nothing found. Texts of any length are scanned whole;
    repeated rows each give a row; ties of document frequency go to the word that comes first in
    the template; other columns are ignored.
    """
    rows = listed(base, templates, share)
    vocabulary = sorted({words[i] for _, _, words, key, _ in rows for i in key})
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.select("doc_id", words_of(F.col("text")).alias("words"))
    literal = lambda words: F.array(*map(F.lit, words))
    counted = source.select(F.explode(F.array_intersect("words", literal(vocabulary))).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counted.collect()}  # one row a vocabulary word

    entries, by_word = [], {}
    for label, is_base, words, key, need in rows:
        by_idf = sorted(key, key=lambda i, words=words: (df.get(words[i], 0), i))
        by_word.setdefault(words[by_idf[0]], []).append((len(entries), by_idf[0]))
        fields = {"words": literal(words), "key": F.array(*map(F.lit, by_idf)), "key_words": literal(list(dict.fromkeys(words[i] for i in by_idf)))}
        fields |= {"label": F.lit(label), "need": F.lit(need), "is_base": F.lit(is_base)}
        entries.append(F.struct(*(c.alias(name) for name, c in fields.items())))
    entries = F.array(*entries)
    posting = lambda x: F.struct(F.lit(x[0]).alias("template"), F.lit(x[1]).alias("at"))
    index = F.create_map(*(c for w, found in sorted(by_word.items()) for c in (F.lit(w), F.array(*map(posting, found)))))
    rare = literal(sorted(by_word))

    source = source.withColumn("own", F.array_intersect("words", literal(vocabulary)))
    possible = lambda p: F.forall(F.get(entries, p["template"])["key_words"], lambda k: F.array_contains("own", k))
    source = source.withColumn("wanted", F.filter(F.array_intersect("own", rare), lambda w: F.exists(index[w], possible)))
    looked_up = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("wanted", x["w"]))
    starts = F.flatten(F.transform(looked_up, lambda x: F.transform(index[x["w"]], lambda p: F.struct(F.get(entries, p["template"]).alias("t"), (x["i"] - p["at"]).alias("start")))))
    words = F.col("words")

    def intersect(c: Column) -> Column:
        there = F.transform(c["t"]["words"], lambda w, i: F.coalesce(F.get(words, c["start"] + i) == w, F.lit(False)))
        hits = F.size(F.filter(there, lambda x: x))
        n = F.size(c["t"]["words"])
        whole = F.forall(c["t"]["key"], lambda k: F.get(there, k))
        return F.struct(
            c["t"]["label"].alias("label"),
            c["start"].cast("long").alias("start"),
            n.cast("long").alias("n_words"),
            c["t"]["is_base"].alias("is_base"),
            (hits / n).alias("score"),
            (whole & (hits >= c["t"]["need"])).alias("ok"),
        )

    kept = F.filter(F.transform(starts, intersect), lambda x: x["ok"])
    found = F.array_sort(F.transform(kept, lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["n_words"].alias("n_words"), x["is_base"].alias("is_base"), x["score"].alias("score"))))
    none = F.array().cast("array<struct<label:string,start:bigint,n_words:bigint,is_base:boolean,score:double>>")
    return source.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("wanted") > 0, found).otherwise(none).alias("found"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of_base = F.filter("found", lambda x: x["is_base"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.withColumn("base", of_base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.col("found.label")).alias("labels"),
        F.coalesce(F.array_max("found.score"), F.lit(0.0)).alias("score"),
    )


def _template_rows() -> str:
    """The templates as rows: template, label, is_base, its length, words needed, length of the key phrase, place, word, whether of the key phrase."""
    rows = []
    for at, (label, is_base, words, key, need) in enumerate(listed(BASE, TEMPLATES, 0.6)):
        rows += [f"({at}, '{label}', {is_base}, {len(words)}, {need}, {len(key)}, {i}, '{word}', {i in key})" for i, word in enumerate(words)]
    return ", ".join(rows)


OP5_SQL = rf"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORD}') AS w
  FROM documents
), template(template, label, is_base, n, need, n_key, offs, word, of_key) AS (VALUES {_template_rows()}
), place AS (SELECT rid, i, w[i + 1] AS word FROM (SELECT rid, w, unnest(range(0, len(w))) AS i FROM dw)
), found AS (
  SELECT rid, label, is_base, i - offs AS start, count(*)::DOUBLE / n AS score
  FROM place JOIN template USING (word) GROUP BY rid, template, label, is_base, n, need, n_key, i - offs
  HAVING count(*) >= need AND count(*) FILTER (of_key) = n_key
), summed AS (
  SELECT rid, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM found GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM dw LEFT JOIN summed USING (rid)
"""
