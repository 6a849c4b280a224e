"""License phrases, and an exact set-similarity join of text blocks with templates.

All of it is DataFrame functions.  A template of s words (LEAST_STEP at least) is compared
with blocks of 2 s words, one of which starts at every s words of a text: a notice is whole
in one of them, however long it is and however its lines are wrapped or marked, and words
far apart aren't in one.  A template matches a block if at least CONTAINMENT of
its distinct words are in the block.  Words are ordered by the number of texts, over
the whole corpus, that hold them, rarest first.  To meet the threshold a block must share
one of the first |T| - need + 1 words of a template (prefix filter), within its own first
|B| - need + 1: only blocks around such words are cut out.  A block must have `need`
words (length filter), and after the first shared prefix word enough words must be left
on both sides (positional filter).  What passes is compared exactly.  Only words of some
template count for |B|, since others can't be shared.

Templates are a small, fixed set; what the driver learns from the corpus is one
count for each of their words.  Texts are read and cut into words once.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns, written

#: Phrases that give a label by themselves.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices of public licenses, a paragraph each, with their labels.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
    ),
    (
        "apache",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "This work has been dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    # whole licenses
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
        "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
]
#: The least s of a block.
LEAST_STEP = 8
CONTAINMENT = 0.9
#: Templates are literals of the plan and their prefixes a broadcast table, up to this many words.
MAX_TEMPLATE_WORDS = 100_000

_SEPARATOR_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _spaced(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def _count(text: Column, part: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def _words_in(spaced: Column) -> Column:
    """Words of a text in which each word has one space before and one behind."""
    return F.when(F.char_length(spaced) == 0, F.lit(0)).otherwise(_count(spaced, "  ") + 1).cast("long")


def _words(template: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template.lower())


def words_of(template: str) -> list[str]:
    """A template's distinct words, in order of the alphabet."""
    return sorted(set(_words(template)))


def step_of(template: str) -> int:
    """The step of the blocks that a template is compared with: as many words as it has."""
    return max(LEAST_STEP, len(_words(template)))


def _phrases(spaced: Column, n_words: Column) -> list[Column]:
    """n_base, first_word, last_word and base (an array of labels); `spaced` words have a space on both sides."""
    n, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        part, size = _spaced(phrase), len(phrase.split())
        there = F.contains(spaced, F.lit(part))
        n.append(F.when(there, _count(spaced, part)).otherwise(F.lit(0)))
        first.append(F.when(there, _words_in(F.substring_index(spaced, part, 1))))
        last.append(F.when(there, n_words - _words_in(F.substring_index(spaced, part, -1)) - size))
        labels.append(F.when(there, F.lit(label)))
    return [sum(n[1:], n[0]).cast("long").alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), F.array_compact(F.array(*labels)).alias("base")]


def read_once(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word, base and known of every text, written.

    known are the text's words in order, null where no template has the word.  The words of
    a text, each with a space on both sides, are searched as a string; only texts that
    hold a phrase's first word are searched for phrases.
    """
    any_case = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _SEPARATOR_ANY_CASE, "  "))
    rows = docs.select("doc_id", "text_hash", ascii_lower(any_case).alias("words"))
    heads = "|".join(sorted({re.escape(p.split()[0]) for p in PHRASES}))
    count = F.when(F.col("words") == "", F.lit(0)).otherwise(_count(F.col("words"), "  ") + 1).cast("long")
    spaced = F.when(F.col("words").rlike(f"(?:^| )(?:{heads})(?: |$)"), F.concat(F.lit(" "), "words", F.lit(" ")))
    known = F.transform(F.split("words", "  "), lambda w: F.when(w.isin(vocabulary), w))
    rows = rows.select("doc_id", "text_hash", count.alias("n_words"), spaced.alias("s"), known.alias("known"))
    return written(rows.select("doc_id", "text_hash", "n_words", *_phrases(F.col("s"), F.col("n_words")), "known"), "words")


def _blocks(read: DataFrame, prefixes: dict[int, list[str]], least: dict[int, int]) -> DataFrame:
    """doc_id, text_hash, step, block and words of the blocks around prefix words, by step."""
    hit = lambda words: F.filter(F.transform("known", lambda w, i: F.when(w.isin(words), i)), lambda i: i.isNotNull())
    near = read.where(F.exists("known", lambda w: w.isin(sorted({w for p in prefixes.values() for w in p}))))

    def of_step(known: Column, step: int) -> Column:
        cells = F.array_distinct(F.flatten(F.transform(hit(prefixes[step]), lambda i: F.array(F.floor(i / step), F.floor(i / step) - 1))))
        inside = lambda k: F.array_distinct(F.array_compact(F.slice(known, (k * step + 1).cast("int"), 2 * step)))
        made = F.transform(F.filter(cells, lambda k: k >= 0), lambda k: F.struct(F.lit(step).alias("step"), k.alias("block"), inside(k).alias("words")))
        return F.filter(made, lambda b: F.size(b["words"]) >= least[step])

    def cut(known: Column) -> Column:
        return F.concat(*[of_step(known, step) for step in sorted(prefixes)])

    # the words are a value of a lambda, so that blocks are slices of one array of objects
    found = F.flatten(F.transform(F.array(F.transform("known", lambda w: w)), cut))
    return near.select("doc_id", "text_hash", F.explode(found).alias("b")).select("doc_id", "text_hash", "b.step", "b.block", "b.words")


def template_matches(read: DataFrame, sets: list[list[str]], steps: list[int], need: list[int]) -> DataFrame:
    """doc_id, text_hash, step, block (a multiple of step is its first word), template (its number), shared words and containment."""
    vocabulary = sorted({w for s in sets for w in s})
    counts = read.select(F.explode(F.array_distinct(F.array_compact("known"))).alias("word")).groupBy("word").count()
    found = {r.word: r["count"] for r in counts.collect()}  # a row for each template word at most
    order = sorted(vocabulary, key=lambda w: (found.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    ranked = [sorted(rank[w] for w in s) for s in sets]
    prefixes = [(step, r, t, place, len(s), n) for t, (s, step, n) in enumerate(zip(ranked, steps, need, strict=True)) for place, r in enumerate(s[: len(s) - n + 1])]
    heads: dict[int, list[str]] = {}
    for step, r, *_ in prefixes:
        heads.setdefault(step, []).append(order[r])
    blocks = _blocks(read, {k: sorted(set(v)) for k, v in heads.items()}, {s: min(n for n, x in zip(need, steps, strict=True) if x == s) for s in set(steps)})
    names = ["step", "rank", "template", "t_place", "t_size", "need"]
    prefix = read.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(f'({", ".join(map(str, p))})' for p in prefixes)} AS t({', '.join(names)})")
    in_order = F.array_sort(F.transform("words", lambda w: F.element_at(F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)]), w)))
    each = blocks.select("doc_id", "text_hash", "step", "block", in_order.alias("ranks"))
    probes = each.select("*", F.posexplode("ranks").alias("b_place", "rank"))
    met = probes.join(F.broadcast(prefix), ["step", "rank"])  # literals: their size is bounded
    left = F.least(F.col("t_size") - F.col("t_place"), F.size("ranks") - F.col("b_place"))
    met = met.where((F.size("ranks") >= F.col("need")) & (F.col("b_place") <= F.size("ranks") - F.col("need")) & (F.col("t_place") + left >= F.col("need")))
    pairs = met.select("doc_id", "text_hash", "step", "block", "ranks", "template", "need", "t_size").distinct()
    whole = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in ranked]), F.col("template") + 1)
    shared = F.size(F.array_intersect("ranks", whole))
    return pairs.withColumn("shared", shared).where("shared >= need").select("doc_id", "text_hash", "step", "block", "template", "shared", (F.col("shared") / F.col("t_size")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    score is the best containment of a template that a block meets, else 0.  Null and
    empty texts have no words; equal rows come out each; rows with one id and
    different texts are judged each by its own text.
    """
    sets = [words_of(t) for _, t in templates]
    need = [math.ceil(containment * len(x) - 1e-9) for x in sets]
    vocabulary = sorted({w for x in sets for w in x})
    if not templates or len(vocabulary) > MAX_TEMPLATE_WORDS or not all(need):
        raise ValueError("templates must have words, and no more than MAX_TEMPLATE_WORDS different ones")
    rows = columns(docs, doc_id=id_column, text=text_column).withColumn("text_hash", F.xxhash64("text"))
    base = read_once(rows, vocabulary)
    names = F.array(*[F.lit(label) for label, _ in templates])
    by_doc = template_matches(base, sets, [step_of(t) for _, t in templates], need).groupBy("doc_id", "text_hash").agg(F.collect_set(F.element_at(names, F.col("template") + 1)).alias("own"), F.max("containment").alias("score"))
    by_doc = by_doc.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "own", "score")
    found = base.join(by_doc, base["doc_id"].eqNullSafe(by_doc["_doc"]) & (base["text_hash"] == by_doc["_hash"]), "left")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    both = F.concat("base", F.coalesce("own", F.array().cast("array<string>")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base").alias("base_labels"), joined(both).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
