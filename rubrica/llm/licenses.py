"""Licence scan over a positional index of rare words.

Templates are whole licence notices. Of each, the rarer half of its words, by document frequency in the
scanned corpus, and the ``AGREE`` rarest words of every mandatory key phrase are posted with their
positions. A file looks up the ``LOOKUPS`` posted words of highest inverse document frequency that it
holds, and the posted words of key phrases. Each posting votes, wherever the word stands in the file, for
a relative position (place in the file minus place in the template); where postings meet in ``AGREE``
votes or more for one relative position, the template is a candidate there. Only then is text compared:
a candidate's key phrases are read at the places it puts them, and the file has the licence where each of
the phrases is confirmed by one of the template's candidates. As the posted words of a phrase agree with
each other wherever it stands, no file with all phrases of a template is missed. The score is the
largest share of a whole template's weight found in place at a candidate of a confirmed template.

Beside that, the fixed phrases of ``PHRASES`` are counted wherever their words stand consecutively.

Built-in functions only and no shuffle but of word counts: postings travel in the plan, as their
number depends on the templates alone. A file's votes grow with its posted words, not with its pairs. Null text is empty and has no words; repeated rows are scanned
alike; long texts are scanned whole, in time proportional to their words; an empty table gives no
rows; ties in rarity fall to the word first in the alphabet. Extra columns are ignored by the scan
whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica.llm.common import NO_WORD_RUN, ascii_lower, read, text_of
from rubrica.session import once

PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Rarest posted words looked up per file beside those of key phrases, and votes for one relative position that make a candidate.
LOOKUPS, AGREE = 16, 2
#: A vote in one number: the template's number above ``_SHIFT`` bits, below them the relative position plus ``_ZERO``.
_SHIFT, _ZERO = 40, 1 << 20

_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
    "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
    "otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)

#: Label, notice, mandatory key phrases; all lower case.
TEMPLATES = [
    (
        "mit-notice",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
        "software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software " + _WARRANTY,
        ["permission is hereby granted free of charge"],
    ),
    ("mit-release", "released under the mit license", ["the mit license"]),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license",
        ["apache license version 2 0"],
    ),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version this program is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
        "general public license for more details",
        ["gnu general public license", "free software"],
    ),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted provided that the above copyright notice and this permission notice appear in all copies the "
        "software is provided as is and the author disclaims all warranties with regard to this software including all "
        "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether "
        "in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
        ["permission to use copy modify and or distribute this software"],
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ["mozilla public license"],
    ),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means",
        ["free and unencumbered software"],
    ),
]


def _words(text: Column) -> Column:
    """The words joined by single blanks."""
    return F.btrim(F.regexp_replace(ascii_lower(text), NO_WORD_RUN, " "), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, " ", ""))).cast("bigint")


def document_frequencies(docs: DataFrame, words: Sequence[str], text: str = "text") -> dict[str, int]:
    """Documents that hold each of ``words``; one count per word reaches the driver."""
    rows = docs.select(F.split(_words(text_of(text)), " ").alias("_all"))
    found = F.array_distinct(F.filter("_all", lambda w: w.isin(list(words))))
    counted = rows.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(words, 0) | {r["word"]: r["count"] for r in counted}


@dataclass(frozen=True)
class Index:
    """``ranked``: the posted words from the rarest on; ``postings``: their (template, position); ``keys``: the posted
    words of key phrases; ``templates``: per label all its (word, position, share of the template's weight)."""

    ranked: list[str]
    postings: dict[str, list[tuple[int, int]]]
    keys: list[str]
    templates: list[tuple[str, list[tuple[str, int, float]]]]


def build_index(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> Index:
    """Count the templates' words in all documents and post the rarer ones.

    A key phrase must stand in its notice and have ``AGREE`` different words, or it could not be found.
    """
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()})
    frequency = document_frequencies(docs, vocabulary, text)
    most = max([1, *frequency.values()])

    def rarest(words: Sequence[str]) -> list[str]:
        return sorted(set(words), key=lambda w: (frequency[w], w))

    postings: dict[str, list[tuple[int, int]]] = {}
    keys, weighted = set(), []
    for number, (label, notice, phrases) in enumerate(templates):
        words = notice.split()
        own = rarest(words)
        chosen = set(own[: (len(own) + 1) // 2])
        for phrase in phrases:
            if len(set(phrase.split())) < AGREE or not _starts(words, phrase.split()):
                raise ValueError(f"{label}: no phrase of {AGREE} different words of its notice: {phrase}")
            keys.update(rarest(phrase.split())[:AGREE])
            chosen.update(rarest(phrase.split())[:AGREE])
        for k, word in enumerate(words):
            if word in chosen:
                postings.setdefault(word, []).append((number, k))
        weights = [math.log2(2 + most / max(1, frequency[w])) for w in words]
        weighted.append((label, [(w, k, x / sum(weights)) for k, (w, x) in enumerate(zip(words, weights))]))
    return Index(rarest(list(postings)), postings, sorted(keys), weighted)


def _starts(words: Sequence[str], phrase: Sequence[str]) -> list[int]:
    return [k for k in range(len(words) - len(phrase) + 1) if list(words[k : k + len(phrase)]) == list(phrase)]


def scan(
    docs: DataFrame, index: Index, keep: Sequence[str] = (), templates=TEMPLATES, text: str = "text", lookups: int = LOOKUPS
) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score to ``keep``."""
    df = once(docs.select(*keep, text_of(text).alias("_text")), _norm=_words(F.col("_text")))
    df = once(
        df,
        _padded=F.concat(F.lit(" "), F.col("_norm"), F.lit(" ")),
        n_words=F.when(F.col("_norm") == "", F.lit(0).cast("bigint")).otherwise(_spaces(F.col("_norm")) + 1),
        _list=F.split("_norm", " "),
    )
    counts, firsts, lasts, names = [], [], [], []
    for phrase, label in PHRASES:
        has = F.contains(F.col("_padded"), F.lit(f" {phrase} "))
        cut = F.split("_padded", f" {phrase}(?= )")
        size = len(phrase.split())
        after = _spaces(F.get(cut, F.size(cut) - 1)) - 1
        counts.append(F.when(has, F.size(cut) - 1).otherwise(0).cast("bigint"))
        firsts.append(F.when(has, _spaces(F.get(cut, F.lit(0)))))
        lasts.append(F.when(has, F.col("n_words") - after - F.lit(size)))
        names.append(F.when(has, F.lit(label)))
    df = once(
        df,
        n_base=reduce(lambda a, b: a + b, counts),
        first_word=F.least(*firsts),
        last_word=F.greatest(*lasts),
        _base=F.array_compact(F.array(*names)),
    )
    df = _with_candidates(df, index, lookups)
    checks, needed = [], []
    for number, (_, notice, phrases) in enumerate(templates):
        needed.append(list(range(sum(map(len, needed)), sum(map(len, needed)) + len(phrases))))
        for p, phrase in zip(needed[-1], phrases):
            checks += [{"t": number, "p": p, "k": k, "words": phrase.split()} for k in _starts(notice.split(), phrase.split())]
    checks = _constant(checks, "array<struct<t:int,p:int,k:int,words:array<string>>>")
    df = once(df, _held=F.array_distinct(F.flatten(F.transform("_found", _confirmed(F.col("_list"), checks)))))
    sure = [reduce(lambda a, b: a & b, [F.array_contains("_held", p) for p in own]) for own in needed]
    df = once(df, _sure=F.array_compact(F.array(*[F.when(s, F.lit(number)) for number, s in enumerate(sure)])))
    names = _constant([label for label, _ in index.templates], "array<string>")
    found = F.transform("_sure", lambda number: F.get(names, number))
    places = [[{"w": w, "k": k, "x": x} for w, k, x in own] for _, own in index.templates]
    places = _constant(places, "array<array<struct<w:string,k:int,x:double>>>")
    own = F.filter("_found", lambda vote: F.array_contains("_sure", _template(vote)))
    shares = F.array_max(F.transform(own, _share(F.col("_list"), places)))
    based = F.when(F.size("_base") > 0, 1.0).otherwise(0.0)
    return df.select(
        *keep,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", found))), ",").alias("labels"),
        F.round(F.least(F.lit(1.0), F.greatest(based, shares)), 6).alias("score"),
    )


def candidates(docs: DataFrame, index: Index, keep: Sequence[str] = (), text: str = "text", lookups: int = LOOKUPS) -> DataFrame:
    """``keep``, the template's label, and the relative position at which its postings met: a row per candidate."""
    df = once(docs.select(*keep, text_of(text).alias("_text")), _list=F.split(_words(F.col("_text")), " "))
    df = _with_candidates(df, index, lookups).select(*keep, F.explode("_found").alias("_one"))
    names = _constant([label for label, _ in index.templates], "array<string>")
    return df.select(*keep, F.get(names, _template(F.col("_one"))).alias("label"), _at(F.col("_one")).alias("at"))


def _with_candidates(df: DataFrame, index: Index, lookups: int) -> DataFrame:
    """Add ``_found``: the candidates among the words ``_list``, as votes, sorted."""
    none = F.array().cast("array<bigint>")
    if not index.postings:
        return df.withColumn("_found", none)

    def hit(word: Column, place: Column) -> Column:
        return F.when(word.isin(list(index.postings)), F.struct(word.alias("w"), place.cast("bigint").alias("i")))

    df = once(df, _hits=F.array_compact(F.transform("_list", hit)))
    held = F.array_distinct(F.transform("_hits", lambda h: h["w"]))
    df = once(df, _rarest=F.slice(F.array_intersect(_constant(index.ranked, "array<string>"), held), 1, lookups))
    # a map is searched from its start on: the commonest words come first
    posted = {w: [(number << _SHIFT) + _ZERO - k for number, k in index.postings[w]] for w in reversed(index.ranked)}
    posted = _constant(posted, "map<string,array<bigint>>")
    looked_up = F.filter("_hits", lambda h: h["w"].isin(index.keys) | F.array_contains("_rarest", h["w"]))
    votes = F.flatten(F.transform(looked_up, lambda h: F.transform(F.element_at(posted, h["w"]), lambda p: p + h["i"])))
    df = once(df, _votes=F.sort_array(votes))

    def met(vote: Column, k: Column) -> Column:
        # votes come sorted, so those that agree are neighbours
        first = (k == 0) | (F.get("_votes", k - 1) != vote)
        return F.when(first & (F.get("_votes", k + F.lit(AGREE - 1)) == vote), vote)

    return once(df, _found=F.array_compact(F.transform("_votes", met)))


def _constant(value, kind: str) -> Column:
    """A value as one literal of the plan; the optimizer parses it once."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def _template(vote: Column) -> Column:
    return F.shiftright(vote, _SHIFT).cast("int")


def _at(vote: Column) -> Column:
    """The relative position of a vote."""
    return (vote.bitwiseAND(F.lit((1 << _SHIFT) - 1)) - F.lit(_ZERO)).cast("int")


def _confirmed(words: Column, checks: Column):
    """The numbers of the key phrases that stand where a candidate puts them."""

    def confirmed(vote: Column) -> Column:
        def stands(c: Column) -> Column:
            at = _at(vote) + c["k"]
            return (c["t"] == _template(vote)) & (at >= 0) & (F.slice(words, at + 1, F.size(c["words"])) == c["words"])

        return F.transform(F.filter(checks, stands), lambda c: c["p"])

    return confirmed


def _share(words: Column, places: Column):
    """The share of a template's weight that a file holds in place, for a candidate."""

    def share(vote: Column) -> Column:
        def add(total: Column, p: Column) -> Column:
            return total + F.when(F.get(words, _at(vote) + p["k"]) == p["w"], p["x"]).otherwise(0.0)

        return F.aggregate(F.get(places, _template(vote)), F.lit(0.0), add)

    return share


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, build_index(docs), ["doc_id"])
