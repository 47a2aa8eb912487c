"""Licence scan with a positional index over the rarest words of licence templates.

Corpus document frequencies of the template words give their IDF. The index holds the postings
(template, position) of each template's rarest words. A file looks up its own licence words from
the rarest on; postings of several words that imply the same start of the same template are
intersected, and a template is reported once its mandatory phrases stand where they should. Phrases
that count exactly are templates whose only mandatory phrase is the whole of them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import slices, text_bytes, word_list

#: Rarest words of a template that are looked up; all must agree on a start within the template's slack.
RARE_WORDS = 4
#: Words by which parts of a template may be moved, and one more for each so many words of a long template.
SLACK, SLACK_EVERY = 2, 25
#: Share of a template's words that must stand at their places (within the slack).
COVERED = 0.7


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases that must occur word by word; none means the whole text.
    mandatory: tuple[str, ...] = ()
    base: bool = False


# Phrases and labels of the contract.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
# Opening or notice sentences of well-known licences.
NOTICES = (
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("apache-2-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("you may not use this file except in compliance with the license",)),
    Template("gpl-2", "under the terms of the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "under the terms of the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    Template("all-rights-reserved", "all rights reserved"),
)
_AS_IS = "the software is provided as is"
# Whole texts of short licences, without the line that names the holder.
WHOLE_TEXTS = (
    Template(
        "mit-full",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", _AS_IS),
    ),
    Template(
        "isc-full",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided "
        "as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ("with or without fee is hereby granted", _AS_IS),
    ),
    Template(
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution this software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"),
    ),
    Template(
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission",
        ("redistribution and use in source and binary forms", "may be used to endorse or promote products"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original "
        "software 2 altered source versions must be plainly marked as such and must not be misrepresented as being the "
        "original software 3 this notice may not be removed or altered from any source distribution",
        ("the origin of this software must not be misrepresented",),
    ),
)
TEMPLATES = BASE + NOTICES + WHOLE_TEXTS


def _words(phrase: str) -> tuple[bytes, ...]:
    return tuple(word_list(phrase.encode()))


class RareWordIndex:
    """Postings of the rarest words of each template."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float], rare_words: int = RARE_WORDS):
        self.templates, self.idf = templates, idf
        self.words = [_words(template.text) for template in templates]
        self.slack = [max(SLACK, len(words) // SLACK_EVERY) for words in self.words]
        self.mandatory = []  # per template: (words, offset in the template)
        self.rarest: list[tuple[bytes, ...]] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(templates):
            words = self.words[t]
            phrases = [_words(p) for p in template.mandatory] or [words]
            self.mandatory.append([(p, _find(words, p)) for p in phrases])
            order = sorted(set(words), key=lambda w: (-idf[w], w))
            rarest = tuple(order[:1] if template.base else order[:rare_words])
            self.rarest.append(rarest)
            for position, word in enumerate(words):
                if word in rarest:
                    self.postings[word].append((t, position))

    def lookup(self, words: list[bytes]) -> dict[int, set[int]]:
        """Template -> starts on which the postings of all its rarest words agree (within the slack)."""
        if self.postings.keys().isdisjoint(words):
            return {}
        places: dict[bytes, list[int]] = defaultdict(list)
        for position, word in enumerate(words):
            if word in self.postings:
                places[word].append(position)
        starts: dict[int, dict[int, set[bytes]]] = defaultdict(lambda: defaultdict(set))
        found: dict[int, set[int]] = {}
        # From the file's rarest licence word on: later words only confirm starts that are known.
        for word in sorted(places, key=lambda w: (-self.idf[w], w)):
            for t, offset in self.postings[word]:
                if not places.keys() >= set(self.rarest[t]):
                    continue
                first = word == next(iter(self.rarest[t]))
                for position in places[word]:
                    start = position - offset
                    if first:
                        starts[t][start].add(word)
                    for shift in range(-self.slack[t], self.slack[t] + 1):
                        if start + shift in starts[t]:
                            starts[t][start + shift].add(word)
        for t, candidates in starts.items():
            agreed = {s for s, seen in candidates.items() if seen >= set(self.rarest[t])}
            if agreed:
                found[t] = agreed
        return found

    def verify(self, words: list[bytes], t: int, start: int) -> float:
        """Share of the template's words in place, 0 if a mandatory phrase is missing."""
        own = self.words[t]
        slack = 0 if self.templates[t].base else self.slack[t]
        for phrase, offset in self.mandatory[t]:
            at = start + offset
            span = range(max(0, at - slack), at + slack + 1)
            if not any(tuple(words[i : i + len(phrase)]) == phrase for i in span):
                return 0.0
        hits = 0
        for i, word in enumerate(own):
            low = max(0, start + i - slack)
            hits += word in words[low : max(0, start + i + slack + 1)]
        return hits / len(own)

    def scan(self, words: list[bytes]) -> tuple[dict[str, list[int]], dict[str, float]]:
        """Base label -> all places of its phrase; label of any template -> best share covered."""
        places: dict[str, list[int]] = {}
        shares: dict[str, float] = {}
        for t, starts in self.lookup(words).items():
            template = self.templates[t]
            good = {s: share for s in starts if (share := self.verify(words, t, s)) >= (1 if template.base else COVERED)}
            if good:
                shares[template.label] = max(good.values())
                if template.base:
                    places[template.label] = sorted(good)
        return places, shares


def _find(words: tuple[bytes, ...], phrase: tuple[bytes, ...]) -> int:
    for i in range(len(words) - len(phrase) + 1):
        if words[i : i + len(phrase)] == phrase:
            return i
    raise ValueError(f"{phrase} is no part of its template")


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each word of a (small, fixed) vocabulary occurs, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches):
            for value in text_bytes(batch, "text"):
                found[b""] += 1
                found.update(vocabulary.intersection(word_list(value)))
        if found:
            words, counts = zip(*sorted(found.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts, pa.int64())], ["word", "n"])

    partial = docs.select(docs[text].alias("text")).mapInArrow(count, "word binary, n long")
    totals = {bytes(row["word"]): row["n"] for row in partial.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    documents = totals.pop(b"", 0)
    return totals, documents


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, *, text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words: zero counts, null places, empty labels, score 0. The score is
    the largest share of a reported template's words that stand in place (1 for an exact phrase).
    """
    vocabulary = frozenset(word for template in templates for word in _words(template.text))
    frequency, documents = document_frequencies(docs, vocabulary, text)
    idf = {word: math.log((1 + documents) / (1 + frequency.get(word, 0))) for word in vocabulary}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareWordIndex(templates, idf)
        for batch in slices(batches):
            rows = []
            for value in text_bytes(batch, "text"):
                words = word_list(value)
                places, shares = index.scan(words)
                starts = [s for found in places.values() for s in found]
                rows.append(
                    (
                        len(words),
                        len(starts),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(places)),
                        ",".join(sorted(shares)),
                        max(shares.values(), default=0.0),
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    names = "doc_id n_words n_base first_word last_word base_labels labels score".split()
    pair = docs.select("doc_id", docs[text].alias("text"))
    kind = pair.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return pair.mapInArrow(scan, schema)
