"""Licence scan: an exact set-similarity join of text blocks with licence templates.

A template is the set of words of a licence notice. It is met at a place of a text
if the span of words that begins there, half as long again as the notice, holds
NEED per cent of its words (all of them if they are few), those that name the
licence among them. Such a word doesn't count where the word before or after it, in the span or not, is one
that makes it the name of a sibling, as in "GNU Lesser" or "BY-SA". Line breaks and comment marks don't count.

Texts are cut into overlapping blocks, so that every span lies in one. The words of the
templates are put in one global order, the rarest in the corpus first; a block is
reduced to those that it holds, in that order. Texts that hold too few words of every
template are left out at once. The join then uses
- the prefix filter: a block that meets a template of t words, of which it must hold r,
  holds one of the first t - r + 1, and it does so within its own first b - r + 1 words,
  b being how many template words it holds at all; the smallest r of all templates
  says how many words of a block are probed;
- the length filter: b is r or more;
- the positional filter: from the first common word on, both must have r words left,
  with the r of that very template.
Only then are the sets intersected, and the spans within the block looked at. All of it
is DataFrame operations; texts are neither shuffled nor compared with each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, words_of

#: Per cent of a template's words that a span must hold, and the number of words below which it must hold all.
NEED, FEW = 80, 10

#: Phrases and the labels they give.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Template:
    """A notice, its label, the words without which it isn't met, and those beside which these name something else."""

    label: str
    text: str
    must: tuple[str, ...] = ()
    bar: tuple[str, ...] = ()


#: Notices as their licences tell authors to write them, and labels of the method's own.
TEMPLATES = (
    Template("notice:apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache",)),
    Template("notice:gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu", "3"), ("lesser", "affero")),
    Template("notice:mit", "Released under the MIT License", ("mit",)),
    Template("notice:cc-by-4.0", "Licensed under CC BY 4.0", ("cc", "by"), ("nc", "sa", "nd")),
    Template("notice:cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("nc",), ("sa", "nd")),
    Template("notice:cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("sa",), ("nc", "nd")),
    Template(
        "notice:apache-text",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache",),
    ),
    Template(
        "notice:mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions",
        ("sublicense",),
    ),
    Template(
        "notice:bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        ("redistributions",),
    ),
    Template(
        "notice:gpl-text",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu",),
        ("lesser", "affero"),
    ),
    Template(
        "notice:lgpl-text",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu", "lesser"),
    ),
    Template(
        "notice:agpl-text",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu", "affero"),
    ),
    Template(
        "notice:isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
        ("fee",),
    ),
    Template(
        "notice:mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("mozilla",),
    ),
    Template(
        "notice:unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("unencumbered",),
    ),
)


def plain_words(text: str) -> list[str]:
    """Words of an ASCII text."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def need_of(n: int) -> int:
    """How many of a template's n words a span must hold."""
    return n if n < FEW else -(-n * NEED // 100)


def span_of(words: list[str]) -> int:
    """Words of the spans in which a template is looked for."""
    return len(words) * 3 // 2


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in plain_words(t.text)})


def may_meet(held: Column, templates=TEMPLATES) -> Column:
    """Whether a text with these template words holds enough of a template's, wherever they stand."""
    out = F.lit(False)
    for x in templates:
        t = sorted(set(plain_words(x.text)))
        if t:
            out = out | (F.size(F.array_intersect(F.lit(t), held)) >= need_of(len(t)))
    return out


def read(docs: DataFrame, templates=TEMPLATES, given=PHRASES) -> DataFrame:
    """doc_id, n_words, base (places of phrases), held (template words of the text), w (its words, where it may meet a template)."""
    heads = sorted({plain_words(p)[0] for p, _ in given})
    known = vocabulary(templates)
    rows = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "w", F.array_intersect(F.lit(sorted({*known, *heads})), "w").alias("held"))
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        phrase_places(F.col("w"), F.col("held"), given).alias("base"),
        F.array_intersect("held", F.lit(known) if known else F.array().cast("array<string>")).alias("held"),
        F.when(may_meet(F.col("held"), templates), F.col("w")).alias("w"),
    )


def ordered_templates(rows: DataFrame, templates=TEMPLATES) -> list[dict]:
    """label, t (words, rarest first), need, span, must and bar of each template; rows: held. The driver gets a number for each word of a template."""
    held = rows.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = dict.fromkeys(vocabulary(templates), 0) | {r["word"]: r["n"] for r in held.collect()}
    out = []
    for x in templates:
        words = plain_words(x.text)
        t = sorted(set(words), key=lambda w: (n[w], w))
        if t:
            out.append({"label": x.label, "t": t, "need": need_of(len(t)), "span": span_of(words), "must": list(x.must), "bar": list(x.bar), "n": n})
    return out


def probes(words: Column, order: list[dict]) -> Column:
    """For each block of a text's words and each of its words that may be the first common one: block (after the word before it), b, q, word.

    b: the block's template words, rarest first; q: the place of word in it.
    """
    n = order[0]["n"]
    ranked = F.lit(sorted({w for x in order for w in x["t"]}, key=lambda w: (n[w], w)))
    heads = F.lit(sorted({w for x in order for w in x["t"][: len(x["t"]) - x["need"] + 1]}))
    least, stride = min(x["need"] for x in order), max(x["span"] for x in order)
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(stride))
    blocks = F.transform(starts, lambda i: F.concat(F.array(F.coalesce(F.get(words, i - 1), F.lit(""))), F.slice(words, i + 1, 2 * stride)))
    held = F.transform(blocks, lambda w: F.struct(w.alias("block"), F.array_intersect(ranked, F.slice(w, 2, 2 * stride)).alias("b")))
    # the length filter with the smallest need, then the words of the prefix of the block that are in the prefix of a template
    held = F.filter(held, lambda x: F.size(x["b"]) >= least)
    few = F.transform(held, lambda x: F.struct(x["block"].alias("block"), x["b"].alias("b"), F.array_intersect(F.slice(x["b"], F.lit(1), F.size(x["b"]) - least + 1), heads).alias("w")))
    few = F.filter(few, lambda x: F.size(x["w"]) > 0)
    return F.flatten(
        F.transform(few, lambda x: F.transform(x["w"], lambda w: F.struct(x["block"].alias("block"), x["b"].alias("b"), (F.array_position(x["b"], w).cast("int") - 1).alias("q"), w.alias("word"))))
    )


def prefixes(docs: DataFrame, order: list[dict]) -> DataFrame:
    """A row for each word of each template's prefix: word, p (its place from 0), label, t, need, span, must, bar."""
    rows = [(w, p, x["label"], x["t"], x["need"], x["span"], x["must"], x["bar"]) for x in order for p, w in enumerate(x["t"][: len(x["t"]) - x["need"] + 1])]
    return docs.sparkSession.createDataFrame(rows, "word string, p int, label string, t array<string>, need int, span int, must array<string>, bar array<string>")


def filtered(b: Column, q: Column) -> Column:
    """Length and positional filter for a probe of a block and a row of prefixes()."""
    return (F.size(b) >= F.col("need")) & (F.size(b) - q >= F.col("need")) & (F.size("t") - F.col("p") >= F.col("need"))


def best_span(block: Column, stride: int) -> Column:
    """The most words of a template that a span beginning in the first half of a block holds, if it meets the template, else 0.

    block: the word before the block, and the block.
    """
    starts = F.filter(F.sequence(F.lit(1), F.least(F.size(block) - 1, F.lit(stride))), lambda i: F.array_contains(F.col("t"), F.get(block, i)))
    barred = lambda k: F.coalesce(F.array_contains(F.col("bar"), F.get(block, k)), F.lit(False))

    def held(i: Column) -> Column:
        here = F.slice(block, i + 1, F.col("span"))
        places = F.filter(F.sequence(i, i + F.col("span") - 1), lambda k: F.coalesce(F.array_contains(F.col("must"), F.get(block, k)), F.lit(False)) & ~barred(k - 1) & ~barred(k + 1))
        named = F.when(F.arrays_overlap(F.col("bar"), F.slice(block, i, F.col("span") + 2)), F.transform(places, lambda k: F.get(block, k))).otherwise(here)
        fine = F.size(F.array_except("must", named)) == 0
        return F.when(fine, F.size(F.array_intersect("t", here))).otherwise(0)

    most = F.coalesce(F.array_max(F.transform(starts, held)), F.lit(0))
    return F.when(most >= F.col("need"), most).otherwise(0)


def phrase_places(words: Column, held: Column, given=PHRASES) -> Column:
    """Places, from 0, where a phrase's words stand consecutively, lines notwithstanding: array of (at, label).

    held: some of the words, the first ones of phrases among them.
    """
    ways = [(plain_words(p), label) for p, label in given]

    def label_at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for p, label in ways:
            out = F.when((F.get(words, i) == p[0]) & (F.slice(words, i + 1, len(p)) == F.lit(p)), F.lit(label)).otherwise(out)
        return out

    heads = F.lit(sorted({p[0] for p, _ in ways}))
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(heads, F.get(words, i)))
    # phrases begin with different words, so that a place has one label at most
    found = F.filter(F.transform(at, lambda i: F.struct(i.alias("at"), label_at(i).alias("label"))), lambda x: x["label"].isNotNull())
    return F.when(F.arrays_overlap(held, heads), found).otherwise(F.array().cast("array<struct<at:int,label:string>>"))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document.

    score is 1 where a phrase occurs, else the largest containment of a
    template that is met, else 0. Null text is empty. Every row is a document, also where rows share a doc_id or
    have none, and comes out once; repeated rows are judged alike, ties don't matter. No documents,
    no rows. Other columns, whatever their names, are ignored. Very long texts and very
    long lines are used whole: blocks are cut from words, not from lines.
    """
    # texts are read once; the words of those that may meet a template, and a few words of the others, are written out
    # with numbers, so that a row's parts come together again
    rows = checkpoint(read(docs, templates).withColumn("row", F.monotonically_increasing_id()))
    order = ordered_templates(rows, templates)
    stride = max((x["span"] for x in order), default=1)
    # the document itself comes first, as a probe that meets nothing
    probed = F.array(F.lit(None).cast("struct<block:array<string>,b:array<string>,q:int,word:string>"))
    mine = F.when(F.col("w").isNull(), probed).otherwise(F.concat(probed, probes(F.col("w"), order))) if order else probed
    rows = rows.select("row", "doc_id", "n_words", "base", mine.alias("probes"))
    rows = rows.select("row", "doc_id", "n_words", "base", F.posexplode("probes").alias("nth", "x")).select("row", "doc_id", "n_words", "base", "nth", "x.*")
    order = F.broadcast(prefixes(docs, order).withColumnRenamed("word", "head"))
    met = rows.join(order, (F.col("word") == F.col("head")) & filtered(F.col("b"), F.col("q")), "left")
    # a block and a template are looked at once, at their first common word
    common = F.array_intersect("t", "b")
    held = F.when((F.get(common, F.lit(0)) == F.col("word")) & (F.size(common) >= F.col("need")), best_span(F.col("block"), stride)).otherwise(0)
    itself = F.col("nth") == 0
    base = F.when(itself, F.col("base")).otherwise(F.array().cast("array<struct<at:int,label:string>>"))
    told = met.select(
        "row",
        "doc_id",
        F.when(itself, F.col("n_words")).otherwise(0).alias("n_words"),
        base.alias("base"),
        "label",
        held.alias("held"),
        F.size("t").alias("of"),
        itself.alias("itself"),
    ).filter("itself or held > 0")
    own = F.when(F.col("itself"), F.transform("base", lambda x: x["label"])).otherwise(F.array("label"))
    score = F.when(F.size("base") > 0, 1.0).when(F.col("held") > 0, F.col("held") / F.col("of")).otherwise(0.0)
    joined = lambda sets: F.array_join(F.array_sort(F.array_distinct(F.flatten(sets))), ",")
    at = F.transform("base", lambda x: x["at"].cast("long"))
    answers = told.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sum("n_words").alias("n_words"),
        F.sum(F.size("base")).alias("n_base"),
        F.min(F.array_min(at)).alias("first_word"),
        F.max(F.array_max(at)).alias("last_word"),
        joined(F.collect_set(F.array_distinct(F.transform("base", lambda x: x["label"])))).alias("base_labels"),
        joined(F.collect_set(F.array_distinct(own))).alias("labels"),
        F.max(score).alias("score"),
    )
    return answers.drop("row")
