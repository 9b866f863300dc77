"""Licence scans by a generalised suffix automaton over licence wordings.

The automaton knows every run of words that occurs in any wording. A text's words are streamed
through it once, and at each word it tells the longest run that ends there and stands in some
wording (matching statistics). Runs that can't be extended are matches; matches with the same
wording, in its order and close together, are chained to spans, and the part of the wording
that a chain covers decides about the label, together with the words that tell the licence from
its relatives: these have to stand in the chain. Known phrases go into the same automaton and
are recognised where they end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Wordings that licences ask to be put into files.
WORDINGS = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this"
        " software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge"
        " publish distribute sublicense and or sell copies of the software",
        "released under the mit license",
        "spdx license identifier mit",
    ],
    "mit-0": ["spdx license identifier mit 0"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or"
        " without fee is hereby granted provided that the above copyright notice and this"
        " permission notice appear in all copies",
        "spdx license identifier isc",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file"
        " except in compliance with the license you may obtain a copy of the license at",
        "licensed under the apache license version 2 0",
        "spdx license identifier apache 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are"
        " permitted provided that the following conditions are met redistributions of source"
        " code must retain the above copyright notice this list of conditions and the following"
        " disclaimer",
        "spdx license identifier bsd 2 clause",
        "spdx license identifier bsd 3 clause",
    ],
    "gpl-3": [
        "this program is free software you can redistribute it and or modify it under the terms"
        " of the gnu general public license as published by the free software foundation either"
        " version 3 of the license or at your option any later version",
        "licensed under the gnu general public license version 3",
        "gnu general public license version 3 29 june 2007 copyright c 2007 free software"
        " foundation",
        "spdx license identifier gpl 3 0",
    ],
    "mpl-2": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a"
        " copy of the mpl was not distributed with this file you can obtain one at",
        "mozilla public license version 2 0",
        "spdx license identifier mpl 2 0",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial"],
    "cc-by-nc-nd": ["creative commons attribution noncommercial noderivatives"],
    "cc-by-nc-sa": ["creative commons attribution noncommercial sharealike"],
    "cc-by-nd": ["licensed under cc by nd 4 0", "creative commons attribution noderivatives"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike"],
    "all-rights-reserved": ["all rights reserved"],
}
#: What tells a licence from others with nearly its wordings: its name and version. A chain has
#: to hold each of these that the wording has, every one in a single match.
DISTINGUISHING = {
    "mit": ["deal in the software", "mit license", "identifier mit"],  # NCSA: deal with
    "mit-0": ["identifier mit 0"],
    "isc": ["identifier isc"],
    "apache-2": ["apache license version 2", "identifier apache 2"],
    "bsd": ["identifier bsd 2 clause", "identifier bsd 3 clause"],
    "gpl-3": ["gnu general public license", "version 3", "identifier gpl 3"],
    "mpl-2": [
        "mozilla public license v 2",
        "mozilla public license version 2",
        "identifier mpl 2",
    ],
    "cc-by-nc": ["by nc", "attribution noncommercial"],
    "cc-by-nc-nd": ["noncommercial noderivatives"],
    "cc-by-nc-sa": ["noncommercial sharealike"],
    "cc-by-nd": ["by nd", "attribution noderivatives"],
    "cc-by-sa": ["by sa", "attribution sharealike"],
}
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A match has so many words at least, or all of a shorter wording or of a distinguishing part.
LEAST_MATCH = 4
#: Words that may stand between two matches of a chain, in the text and in the wording.
MOST_GAP = 12
#: The part of a wording that a chain has to cover.
LEAST_COVER = 0.75
#: Label, words of the wording covered, part of it, first and last word in the text.
Span = tuple[str, int, float, int, int]


class Automaton:
    """Generalised suffix automaton of sequences of words."""

    def __init__(
        self,
        wordings: dict[str, list[str]],
        phrases: dict[str, str],
        distinguishing: dict[str, list[str]] | None = None,
    ):
        self.next: list[dict[bytes, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.wordings = [
            (label, text.encode().split()) for label, texts in wordings.items() for text in texts
        ]
        known = [(label, text.encode().split()) for text, label in phrases.items()]
        for _, words in self.wordings + known:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: The wordings and places where a state's runs end, and the phrases that end there.
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.next]
        #: Where the distinguishing parts of each wording stand (first word, word after).
        self.parts = [
            [
                (at, at + len(part))
                for part in (p.encode().split() for p in (distinguishing or {}).get(label, []))
                for at in range(len(words) - len(part) + 1)
                if words[at : at + len(part)] == part
            ]
            for label, words in self.wordings
        ]
        ends = defaultdict(list)
        for number, (_, words) in enumerate(self.wordings):
            for end, state in enumerate(self._walk(words), 1):
                ends[state].append((number, end))
        for state, own in ends.items():
            while state > 0:
                self.places[state] += own
                state = self.link[state]
        #: The words that a match ending in a state has at least.
        self.least = [
            min([LEAST_SHORT, *(n for number, end in own if (n := self._short(number, end)))])
            for own in self.places
        ]
        finals = {}
        for label, words in known:
            finals.setdefault([*self._walk(words)][-1], []).append((len(words), label))
        for state in range(1, len(self.next)):
            up = state
            while up > 0:
                self.phrases[state] += finals.get(up, [])
                up = self.link[up]

    def _walk(self, words: list[bytes]) -> Iterator[int]:
        state = 0
        for word in words:
            state = self.next[state][word]
            yield state

    def _short(self, number: int, end: int) -> int | None:
        """The length from which on a match that ends there has a distinguishing part."""
        return min((end - a for a, b in self.parts[number] if b <= end), default=None)

    def _new(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _halved(self, state: int, word: bytes) -> int:
        """The state that ``word`` leads to from ``state``, cut off from longer runs."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        twin = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._halved(last, word)
        made = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = made
            last = self.link[last]
        if last >= 0:
            self.link[made] = self._halved(last, word)
        return made

    def scan(
        self, words: list[bytes]
    ) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
        """Places of phrases (start, end, label), and matches (state, end, length) that no
        further word extends, for the words of a text."""
        phrases, matches = [], []
        state = length = 0
        edges, link, sizes, ends = self.next, self.link, self.length, self.phrases
        least = self.least
        vocabulary, past = edges[0], -2
        for i in [i for i, word in enumerate(words) if word in vocabulary]:
            if i != past + 1:
                if length >= least[state]:
                    matches.append((state, past, length))
                state = length = 0
            past, word = i, words[i]
            if word not in edges[state] and length >= least[state]:
                matches.append((state, i - 1, length))
            while word not in edges[state]:
                state = link[state]
                length = sizes[state]
            state, length = edges[state][word], length + 1
            if ends[state]:
                phrases += [(i - n + 1, i, label) for n, label in ends[state] if n <= length]
        if length >= least[state]:
            matches.append((state, past, length))
        return phrases, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, float, int, int]]:
        """Label, part of the wording covered, first and last word in the text, of the chains
        that no stronger one overlaps."""
        return [(label, *rest) for label, _, *rest in strongest(self.chained(matches))]

    def chained(self, matches: list[tuple[int, int, int]]) -> list[Span]:
        """The chains that cover enough of a wording, with all its distinguishing parts."""
        by_wording = defaultdict(list)
        for state, end, length in matches:
            for number, place in self.places[state]:
                short = self._short(number, place) or LEAST_MATCH
                if length >= min(LEAST_MATCH, len(self.wordings[number][1]), short):
                    by_wording[number].append((end, place, length))
        found = []
        for number, own in by_wording.items():
            label, words = self.wordings[number]
            own.sort()
            parts = self.parts[number]
            # Distinguishing parts held (bits), words covered, first word in the text.
            chains: list[tuple[int, int, int]] = []
            recent = 0
            for i, (end, place, length) in enumerate(own):
                inside = sum(
                    1 << k for k, (a, b) in enumerate(parts) if place - length <= a and b <= place
                )
                held, covered, first = inside, length, end - length + 1
                while own[recent][0] < end - length - MOST_GAP:
                    recent += 1
                for j in range(recent, i):
                    before, at, _ = own[j]
                    gap = min(length, end - before, place - at)
                    if end > before and 0 < place - at <= length + MOST_GAP:
                        both, more = chains[j][0] | inside, chains[j][1] + gap
                        if (both.bit_count(), more) > (held.bit_count(), covered):
                            held, covered, first = both, more, chains[j][2]
                chains.append((held, covered, first))
                part = min(1.0, covered / len(words))
                if held.bit_count() == len(parts) and part >= LEAST_COVER:
                    found.append((label, min(covered, len(words)), part, first, end))
        return found


def strongest(spans: list[Span]) -> list[Span]:
    """The spans that don't overlap one with more words covered."""
    kept: list[Span] = []
    taken: list[tuple[int, int]] = []  # stretches of the text, in order and apart
    for _, level in groupby(sorted(spans, key=lambda span: -span[1]), key=lambda span: span[1]):
        free = []
        for span in level:
            at = bisect_right(taken, span[4], key=lambda stretch: stretch[0])
            if not at or taken[at - 1][1] < span[3]:
                free.append(span)
        kept += free
        merged: list[tuple[int, int]] = []
        for first, last in sorted(taken + [span[3:] for span in free]):
            if merged and first <= merged[-1][1]:
                first, last = merged[-1][0], max(last, merged.pop()[1])
            merged.append((first, last))
        taken = merged
    return kept


LEAST_SHORT = min(LEAST_MATCH, *(len(t.split()) for texts in WORDINGS.values() for t in texts))
RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string,"
    " labels string, score double, span_first long, span_last long"
)


def scan_text(automaton: Automaton, text: str | None) -> tuple:
    words = WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    phrases, matches = automaton.scan(words)
    spans = automaton.spans(matches) if matches else []
    starts = [p[0] for p in phrases]
    base = {p[2] for p in phrases}
    return (
        len(words),
        len(phrases),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(base | {s[0] for s in spans})),
        1.0 if base else max((s[1] for s in spans), default=0.0),
        min([*starts, *(s[2] for s in spans)], default=None),
        max([*(p[1] for p in phrases), *(s[3] for s in spans)], default=None),
    )


def scan_licences(
    docs: DataFrame,
    wordings: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    distinguishing: dict[str, list[str]] | None = None,
) -> DataFrame:
    """``doc_id`` and the columns of ``RESULT``, for every row's whole text.

    ``n_base`` to ``base_labels`` are about the phrases alone, ``labels`` and ``score`` about
    wordings too; ``span_first`` and ``span_last`` are the outermost words of all that was
    found. A null text counts as empty: no words, no labels, score 0. Label lists are empty
    strings where there is nothing. Other columns are ignored.
    """
    wordings = WORDINGS if wordings is None else wordings
    phrases = PHRASES if phrases is None else phrases
    distinguishing = DISTINGUISHING if distinguishing is None else distinguishing
    names = [part.split()[0] for part in RESULT.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.int64()] * 2

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(wordings, phrases, distinguishing)
        for batch in batches:
            rows = [scan_text(automaton, text) for text in batch["text"].to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], ["doc_id", *names])

    known = docs.select(F.col("doc_id").cast("long"), "text")
    return known.mapInArrow(scanned, "doc_id long, " + RESULT)
