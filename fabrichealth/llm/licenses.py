"""License scan by diagonal voting, in DataFrame functions only.

A template is a license notice. Every run of ``GRAM`` words of a text is hashed and joined to the places where the
templates hold that run. A match at word i of the text and word j of the template lies on the diagonal i - j; matches
are counted by text, template and diagonal. Diagonals of one template that lie within a few words of each other
are one passage whose words were inserted or left out, and are merged. A merged passage is then verified on the words
themselves: the share of the template's words that stand in the text on one of its diagonals must reach
``SHARE``, and the template's telling words must be among them.

Base phrases give their labels wherever their words stand one after another; the templates' labels come on top.
``score`` is 1 with a base phrase, else the largest share of a verified passage, 0 without one.

Words are runs of letters, digits and characters above ASCII, A-Z lower-cased; whole texts are scanned. Null or
empty texts have no words and no labels. Repeated rows are scanned alike and give a row each, null doc_ids too. An empty
table gives no rows; extra columns are ignored. Runs and rows are told apart by 64-bit hashes; a run's collision ends at
the verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.llm.common import settle

#: Words of a run, share of a template's words that a passage must hold, words by which neighbouring diagonals may differ.
GRAM, SHARE, SHIFT = 3, 0.6, 8
#: Passages up to this many (about 100 bytes each) are broadcast to the texts; more are joined on their key.
BROADCAST_PASSAGES = 300_000
#: Bytes of templates that may be sent to every task.
TEMPLATE_BYTES = 4_000_000

SEPARATORS = r"[\x00-/:-`{-\x7F]+"
#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, telling words, and the public notices of common licenses.
TEMPLATES = [
    ("mit", "mit", "Released under the MIT License"),
    ("mit", "mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("isc", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", "apache 2 0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "gnu general public", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "lesser", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "affero", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("epl-2.0", "eclipse", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0"),
    ("cc-by", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "sharealike", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "cc nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "cc sa", "Licensed under CC BY-SA 4.0"),
    ("warranty", "", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"),
]


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased. ``lower`` moves other letters too, which changes no boundary and, but
    for the sign that lowers to an ASCII k, makes no ASCII word; that sign is set aside first."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(low, SEPARATORS), "")


def grams_of(words: Column, gram: int = GRAM) -> Column:
    """The hash of the run of words at each place."""
    return F.when(F.size(words) >= gram, F.transform(F.sequence(F.lit(1), F.size(words) - (gram - 1)), lambda i: F.xxhash64(F.slice(words, i, gram)))).otherwise(F.array().cast("array<bigint>"))


def template_words(spark, templates: list[tuple[str, str, str]]) -> DataFrame:
    """no, label, telling, words of (label, telling words, text)."""
    if sum(len(t) for _, _, t in templates) > TEMPLATE_BYTES:
        raise ValueError(f"templates of more than {TEMPLATE_BYTES} characters are not sent to every task")
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "no int, label string, telling string, text string")
    return rows.select("no", "label", words_of(F.col("telling")).alias("telling"), words_of(F.col("text")).alias("words"))


def row_key() -> Column:
    """Tells rows of ``docs`` apart by doc_id and text; equal rows share it."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))


def passages(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """key, no and the diagonals of each merged passage of ``docs(doc_id, text)``, with its votes."""
    places = templates.select("no", F.size("words").alias("length"), F.posexplode(grams_of(F.col("words"))).alias("j", "gram"))
    texts = docs.select(row_key().alias("key"), words_of(F.col("text")).alias("words"))
    grams = texts.select("key", F.posexplode(grams_of(F.col("words"))).alias("i", "gram"))
    hits = grams.join(F.broadcast(places), "gram").select("key", "no", "length", (F.col("i") - F.col("j")).alias("diagonal"), "j").distinct()
    votes = hits.groupBy("key", "no", "length", "diagonal").agg(F.count("*").alias("votes"))
    along = W.partitionBy("key", "no").orderBy("diagonal")
    shift = F.least(F.lit(SHIFT), F.greatest(F.lit(1), F.floor(F.col("length") / 4)))
    parted = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(along) > shift).cast("int")).withColumn("passage", F.sum(F.coalesce("new", F.lit(0))).over(along))
    return parted.groupBy("key", "no", "passage").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"), F.sum("votes").alias("votes")).drop("passage")


def verified(docs: DataFrame, found: DataFrame, templates: list[tuple[str, str, str]]) -> DataFrame:
    """doc_id, words and spans (label, no, first, last, share) of every row of ``docs``, from the passages found."""
    spark = docs.sparkSession
    known = [r.asDict() for r in template_words(spark, templates).orderBy("no").collect()]  # bounded by TEMPLATE_BYTES
    listed = lambda x: F.array(*[F.array_remove(F.split(F.lit(" ".join(t[x])), " "), "") for t in known]).cast("array<array<string>>")
    lists, telling = listed("words"), listed("telling")
    labels = F.array(*[F.lit(t["label"]) for t in known]).cast("array<string>")
    by_key = found.groupBy("key").agg(F.collect_list(F.struct("no", "diagonals")).alias("passages"))
    by_key = settle(by_key, "passages")
    small = F.broadcast(by_key) if by_key.count() <= BROADCAST_PASSAGES else by_key
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), words_of(F.col("text")).alias("words")).join(small, "key", "left")

    def held(p):
        """The template's places whose word stands in the text on one of the passage's diagonals."""
        own = F.get(lists, p["no"])
        place = lambda j: F.exists(p["diagonals"], lambda d: F.get("words", d + j) == F.get(own, j))
        return F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda j: F.coalesce(place(j), F.lit(False)))

    def span(p):
        own, at = F.get(lists, p["no"]), held(p)
        return F.struct(
            F.get(labels, p["no"]).alias("label"),
            p["no"].alias("no"),
            F.greatest(F.lit(0), F.array_min(p["diagonals"])).cast("long").alias("first"),
            F.least(F.size("words") - 1, F.array_max(p["diagonals"]) + F.size(own) - 1).cast("long").alias("last"),
            at.alias("at"),
            (F.size(at) / F.size(own)).alias("share"),
        )

    told = lambda s: F.size(F.array_except(F.get(telling, s["no"]), F.transform(s["at"], lambda j: F.get(F.get(lists, s["no"]), j)))) == 0
    spans = F.filter(F.transform("passages", span), lambda s: (s["share"] >= SHARE) & told(s))
    none = F.array().cast("array<struct<label:string,no:int,first:bigint,last:bigint,at:array<int>,share:double>>")
    out = rows.withColumn("spans", F.when(F.col("passages").isNull(), none).otherwise(spans))
    return out.select("doc_id", "words", F.transform("spans", lambda s: s.dropFields("at")).alias("spans"))


def phrase_places(phrase: str) -> Column:
    """The places in ``words`` where the phrase's words stand one after another."""
    first, *rest = phrase.split()
    after = lambda i: [F.coalesce(F.get("words", i + k + 1) == w, F.lit(False)) for k, w in enumerate(rest)]

    def stands(i):
        test = F.get("words", i) == first
        for x in after(i):
            test = test & x
        return test

    all_there = F.lit(True)
    for w in (first, *rest):
        all_there = all_there & F.array_contains("words", w)
    none = F.array().cast("array<int>")
    return F.when(all_there, F.filter(F.sequence(F.lit(0), F.size("words") - 1), stands)).otherwise(none)


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of ``docs(doc_id, text)``.

    ``spans`` has label, template number, first and last word and share of every verified passage.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    texts = docs.select("doc_id", "text")
    found = passages(texts, template_words(docs.sparkSession, templates))
    rows = verified(texts, found, templates)
    places = rows.withColumn("_base", F.array(*[phrase_places(p) for p in phrases]).cast("array<array<int>>"))
    every = F.flatten("_base")
    names = F.array(*[F.when(F.size(F.get("_base", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(phrases.values())]).cast("array<string>")
    base = F.filter(names, lambda x: x.isNotNull())
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return places.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))).alias("score"),
        "spans",
    )


def oracle() -> str:
    """The digest's rows in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quote(label)}, {quote(telling)}, {quote(text)})" for i, (label, telling, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({quote(p)}, {quote(label)})" for p, label in PHRASES.items())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = lambda x: rf"regexp_extract_all(translate({x}, '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
with d as materialized (select row_number() over () as row_id, doc_id, {words("coalesce(text, '')")} as words from documents),
t as materialized (select no, label, {words("telling")} as telling, {words("text")} as words from (values {templates}) v(no, label, telling, text)),
p as (select phrase, label, {words("phrase")} as words from (values {phrases}) v(phrase, label)),
w as (select row_id, generate_subscripts(words, 1) - 1 as i, unnest(words) as w1 from d),
w3 as materialized (select row_id, i, w1, lead(w1) over k as w2, lead(w1, 2) over k as w3 from w window k as (partition by row_id order by i)),
tw as (select no, len(words) as length, generate_subscripts(words, 1) - 1 as j, unnest(words) as w1 from t),
t3 as (select no, length, j, w1, lead(w1) over k as w2, lead(w1, 2) over k as w3 from tw window k as (partition by no order by j)),
v as (select distinct row_id, no, length, i - j as diagonal from w3 join t3 using (w1, w2, w3)),
n as (select *, case when diagonal - lag(diagonal) over k > least({SHIFT}, greatest(1, length // 4)) then 1 else 0 end as fresh from v window k as (partition by row_id, no order by diagonal)),
g as (select *, sum(fresh) over (partition by row_id, no order by diagonal) as passage from n),
h as (select distinct g.row_id, g.no, g.passage, g.length, tw.j, tw.w1 from g join tw on tw.no = g.no join w on w.row_id = g.row_id and w.i = g.diagonal + tw.j and w.w1 = tw.w1),
s as (select row_id, no, passage, count(*) / any_value(length) as share, list(w1) as held from h group by all),
ok as (select row_id, t.label, share from s join t using (no) where share >= {SHARE} and list_has_all(held, telling)),
b as (select w3.row_id, i, p.label from w3 join p on w3.w1 = p.words[1] and w3.w2 = p.words[2] and (len(p.words) = 2 or w3.w3 = p.words[3])),
bs as (select row_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(label) as labels from b group by all),
os as (select row_id, max(share) as share, list(label) as labels from ok group by all)
select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  array_to_string(list_sort(list_distinct(coalesce(bs.labels, []))), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(os.labels, [])))), ',') as labels,
  case when n_base > 0 then 1.0 else coalesce(share, 0.0) end as score
from d left join bs using (row_id) left join os using (row_id)"""
