"""License scan by a positional index over the rarest words of licence templates.

Contract: a text's words are its maximal runs of digits, letters and characters beyond ASCII, A-Z
lower-cased. A licence word weighs v = max(1, floor(1000 ln((2 N + 2) / (2 df + 1)))), with N the number of
rows and df the number of rows whose text holds the word. A template stands at word p of a text when the
words that it shares with the text, place by place from p on, carry at least four fifths of the weight of all
its words and every word of its key phrases is among them; p may lie before the first word if only the head
is cut off. That share is the score of the span. Base templates are phrases that are wholly key phrase.
Null text is empty and has no words and no spans. Every row is scanned for itself, so ties and repeated rows,
also of one or no doc_id, give equal results; extra columns are ignored; an empty table gives no rows.

Method: the first pass over all texts counts df. A template's places are ordered by falling weight, and the
rarest ones that together carry over three fifths of it make its postings (word -> template, place). The second
pass looks up a file's words of the index, the rarest first; each hit votes for the start at which
template and text would agree. As at most a fifth of the weight may miss, a start that qualifies keeps at least
the postings' weight less a fifth: starts below that are left, the others are verified word by word with their
key phrases. No start that meets the contract is lost. The index is as small as the templates; no
text is shuffled. Long texts are read in parts that overlap by more than a template.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches


class Template(NamedTuple):
    """A licence notice, the phrases in it that must stand whole, and whether it is a base phrase."""

    label: str
    text: str
    key_phrases: tuple[str, ...]
    base: bool = False


#: Fixed base phrases and their labels.
BASE = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
)

#: Opening sentences of public licences and customary notices; a parameter of the scan.
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("has waived all copyright",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "3")),
    Template("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "this software")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
)

TEMPLATES = BASE + NOTICES
TEXT_PART = 1 << 20
#: Bytes of UTF-8 that belong to words; A-Z become a-z, all others a space.
FOLDED = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLDED).split()


def text_parts(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, part by part; parts end between words."""
    line, at = (text or b"").translate(FOLDED), 0
    while at < len(line):
        cut = line.find(b" ", at + TEXT_PART)
        cut = len(line) if cut < 0 else cut
        yield line[at:cut].split()
        at = cut


def key_places(template: Template) -> list[int]:
    """Places of the words of all key phrases; a phrase that the template lacks is an error of the registry."""
    words, places = words_of(template.text), set()
    for phrase in template.key_phrases:
        key = words_of(phrase)
        starts = [p for p in range(len(words) - len(key) + 1) if words[p : p + len(key)] == key]
        if not starts:
            raise ValueError(f"{phrase!r} is no part of the template {template.text!r}")
        places |= set(range(starts[0], starts[0] + len(key)))
    return sorted(places)


class Index:
    """Weights and postings of all templates for one corpus."""

    def __init__(self, templates: tuple[Template, ...], n_rows: int, df: dict[bytes, int]):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        self.keys = [key_places(t) for t in templates]
        self.weights = [[max(1, math.floor(1000 * math.log((2 * n_rows + 2) / (2 * df.get(w, 0) + 1)))) for w in words] for words in self.words]
        self.totals = [sum(weights) for weights in self.weights]
        self.longest = max((len(words) for words in self.words), default=0)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.least_votes = []
        for number, (words, weights, total) in enumerate(zip(self.words, self.weights, self.totals)):
            held = 0
            for place in sorted(range(len(words)), key=lambda p: (-weights[p], p)):
                if 5 * held > 3 * total:
                    break
                held += weights[place]
                self.postings[words[place]].append((number, place))
            self.least_votes.append(held - total // 5)
        self.rare_words = frozenset(self.postings)

    def starts(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, start) pairs whose votes by relative position allow a match."""
        if self.rare_words.isdisjoint(words):
            return []
        votes: Counter = Counter()
        for place, word in enumerate(words):
            for number, at in self.postings.get(word, ()):
                votes[number, place - at] += self.weights[number][at]
        return [pair for pair, weight in votes.items() if weight >= self.least_votes[pair[0]]]

    def share(self, number: int, start: int, words: list[bytes]) -> float:
        """Share of the weight that agrees from ``start`` on; zero if it is too small or a key phrase is broken."""
        own = self.words[number]
        equal = [0 <= start + j < len(words) and words[start + j] == word for j, word in enumerate(own)]
        weight = sum(w for w, same in zip(self.weights[number], equal) if same)
        found = 5 * weight >= 4 * self.totals[number] and all(equal[j] for j in self.keys[number])
        return weight / self.totals[number] if found else 0.0

    def spans(self, text: bytes | None) -> tuple[int, dict[tuple[int, int], float]]:
        """Number of words, and the share of every (template, start) found."""
        n, tail, found = 0, [], {}
        for part in text_parts(text):
            words, before = tail + part, n - len(tail)
            for number, start in self.starts(words):
                share = self.share(number, start, words)
                if share:
                    found[number, before + start] = max(share, found.get((number, before + start), 0.0))
            n += len(part)
            tail = words[max(len(words) - 2 * self.longest, 0) :]
        return n, found


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of rows, and of the rows that hold each word of the templates."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts[b""] += batch.num_rows
            for text in batch.column(0):
                held: set[bytes] = set()
                for words in text_parts(text.as_py()):
                    held |= vocabulary.intersection(words)
                counts.update(held)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = text_bytes(docs, []).mapInArrow(apply, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(row["word"]): row["n"] for row in rows}
    return df.pop(b"", 0), df


def text_bytes(docs: DataFrame, others: list[Column]) -> DataFrame:
    return bounded_batches(docs).select(F.col("text").cast("string").cast("binary").alias("text"), *others)


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Columns doc_id, n_words and spans (label, base, start, length, share) in order of start and label."""
    vocabulary = frozenset(word for t in templates for word in words_of(t.text))
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, *document_frequencies(docs, vocabulary)))
    span = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("length", pa.int64()), ("share", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            sizes, spans = [], []
            for text in batch.column(0):
                n, found = held.spans(text.as_py())
                rows = [(start, held.templates[number].label, held.templates[number].base, len(held.words[number]), share) for (number, start), share in found.items()]
                sizes.append(n)
                spans.append([{"label": label, "base": base, "start": start, "length": length, "share": share} for start, label, base, length, share in sorted(rows)])
            columns = [batch.column(1), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "spans"])

    schema = "doc_id long, n_words long, spans array<struct<label:string,base:boolean,start:bigint,length:bigint,share:double>>"
    return text_bytes(docs, [F.col("doc_id").cast("long").alias("doc_id")]).mapInArrow(apply, schema)


def joined_labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def summarised(found: DataFrame) -> DataFrame:
    """One line per scanned document: base places, their range, labels and the best share."""
    base = F.filter("spans", lambda s: s["base"])
    places = F.transform(base, lambda s: s["start"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined_labels(base).alias("base_labels"),
        joined_labels(F.col("spans")).alias("labels"),
        best.alias("score"),
    )


def sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same over the table ``documents``, by comparing every start instead of looking up rare words."""
    rows = []
    for number, t in enumerate(templates):
        keys = set(key_places(t))
        rows += [f"({number}, '{t.label}', {str(t.base).lower()}, {place}, '{word.decode()}', {str(place in keys).lower()})" for place, word in enumerate(words_of(t.text))]
    return SQL.replace("$ROWS", ", ".join(rows))


SQL = r"""
WITH template_words(template, label, base, place, word, key) AS (VALUES $ROWS),
texts AS (
  SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
placed AS (SELECT doc, unnest(words) AS word, unnest(range(len(words))) AS pos FROM texts),
known AS (SELECT * FROM placed WHERE word IN (SELECT word FROM template_words)),
frequency AS (SELECT word, count(DISTINCT doc) AS df FROM known GROUP BY word),
weighted AS (
  SELECT t.*, greatest(1, floor(1000 * ln((2 * (SELECT count(*) FROM texts) + 2) / (2 * coalesce(df, 0) + 1)))::BIGINT) AS v
  FROM template_words t LEFT JOIN frequency USING (word)),
totals AS (SELECT template, label, base, sum(v)::BIGINT AS total, count(*) FILTER (key) AS keys FROM weighted GROUP BY ALL),
agreed AS (
  SELECT doc, template, pos - place AS start, sum(v)::BIGINT AS v, count(*) FILTER (key) AS keys
  FROM known JOIN weighted USING (word) GROUP BY ALL),
found AS (
  SELECT doc, label, base, start, a.v / total AS share FROM agreed a JOIN totals t USING (template)
  WHERE a.keys = t.keys AND 5 * a.v >= 4 * total),
summed AS (
  SELECT doc, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM found GROUP BY doc)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM texts LEFT JOIN summed USING (doc)
"""
