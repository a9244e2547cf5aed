"""License scans: exact phrases of words, and short notices with bounded errors.

A notice of n characters may differ in ``errors(n)`` edits. Cut into one piece more than that, at
least one piece stays whole (pigeonhole), so an Aho-Corasick pass over the pieces of all notices finds
every candidate place; around it, the regex library's bounded-error matching verifies the notice,
counts the edits and gives the span. Its best match in a stretch comes first, and the parts before and
after are searched again, so notices side by side are all found. Words of up to three letters must stand
as they are: one edit turns too many of them into other words.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vector_atlas.llm import textbuf
from vector_atlas.llm.tables import map_batches

#: Phrases of consecutive words and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Short notices, lower case, and their labels (the public wording of the licences).
NOTICES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("gnu general public license", "gpl"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("licensed under the apache license, version 2.0", "apache"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("redistribution and use in source and binary forms, with or without modification", "bsd"),
    ("permission to use, copy, modify, and/or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("all rights reserved", "reserved"),
    ("spdx-license-identifier", "spdx"),
)


WORD = re.compile("[a-z0-9]+")
SHORT = 3  # words of at most this many letters allow no edits


def errors(n: int) -> int:
    """Edits allowed in a notice of ``n`` characters: one in ten, one at least."""
    return max(1, n // 10)


class Scanner:
    """The seeds of all notices in one automaton, and a bounded-error pattern per notice."""

    def __init__(self, notices=NOTICES):
        import ahocorasick
        import regex

        self.labels = [label for _, label in notices]
        self.lengths = [len(text) for text, _ in notices]
        self.bounds = [errors(n) for n in self.lengths]
        self.patterns = [
            regex.compile(f"(?b)(?<![a-z0-9])(?:{regex.escape(text)}){{e<={k}}}(?![a-z0-9])") for (text, _), k in zip(notices, self.bounds)
        ]
        self.exact = [[w for w in WORD.findall(text) if len(w) <= SHORT] for text, _ in notices]
        seeds: dict[str, list] = {}
        for i, (text, _) in enumerate(notices):
            cuts = np.linspace(0, len(text), self.bounds[i] + 2).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((i, b))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, places)
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """``label, start, end, edits`` of every verified notice, in order of start; ``text`` is lower case."""
        windows: dict[int, list] = {}
        for last, places in self.automaton.iter(text):
            for i, end in places:
                start = last + 1 - end
                k = self.bounds[i]
                lo, hi = max(0, start - k), min(len(text), start + self.lengths[i] + k)
                own = windows.setdefault(i, [])
                if own and lo <= own[-1][1]:
                    own[-1] = (min(lo, own[-1][0]), max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
        found = []
        for i, own in windows.items():
            for lo, hi in own:
                # one character more on each side lets the bounds of the match see what follows
                at = max(0, lo - 1)
                found += [(self.labels[i], at + a, at + b, edits, self.lengths[i]) for a, b, edits in self.verified(i, text[at : hi + 1])]
        return sorted(set(found), key=lambda x: (x[1], x[2], x[0]))

    def verified(self, i: int, stretch: str) -> list[tuple[int, int, int]]:
        """``start, end, edits`` of the notice ``i`` in a stretch: the best match, then those before and behind it."""
        found, todo = [], [(0, len(stretch))]
        while todo:
            lo, hi = todo.pop()
            m = self.patterns[i].search(stretch, lo, hi)
            if m is None or m.end() == m.start():
                continue
            words = iter(WORD.findall(m.group()))
            if all(w in words for w in self.exact[i]):  # each in turn, in order
                found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                todo += [(lo, m.start()), (m.end(), hi)]
            else:
                todo += [(lo, m.start()), (m.start() + 1, hi)]
        return found


def _phrase_hashes(phrases):
    import pyarrow as pa

    powers, word_bytes = textbuf.Powers(), textbuf.alnum_words()
    out = []
    for _, data, offs in textbuf.chunks(pa.array([p for p, _ in phrases])):
        words = textbuf.Words(data, offs, word_bytes, powers)
        out += [words.hashes[a:b] for a, b in zip(words.offs[:-1], words.offs[1:])]
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per document: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    Words run over the lower-cased text; null and empty texts have none. ``spans`` are the fuzzy notices
    (label, code-point range, edits) in the order of their starts; notices that overlap are all given. ``score`` is 1 with an exact phrase, else the best notice's share
    of unedited characters, 0 without one.
    """
    import pyarrow as pa

    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))

    def start():
        return textbuf.Powers(), textbuf.alnum_words(), Scanner(notices), _phrase_hashes(phrases)

    def step(state, batch):
        powers, word_bytes, scanner, wanted = state
        for lo, data, offs in textbuf.chunks(batch.column(1)):
            words = textbuf.Words(data, offs, word_bytes, powers)
            rows = len(offs) - 1
            n_words = np.diff(words.offs)
            doc = np.repeat(np.arange(rows), n_words)
            at, label = [], []
            for p, h in enumerate(wanted):
                n = len(words.hashes) - len(h) + 1
                if n <= 0:
                    continue
                hit = np.ones(n, dtype=bool)
                for j in range(len(h)):
                    hit &= words.hashes[j : j + n] == h[j]
                places = np.flatnonzero(hit)
                places = places[doc[places] == doc[places + len(h) - 1]]
                at.append(places)
                label.append(np.full(len(places), p))
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            label = np.concatenate(label) if label else at
            n_base = np.bincount(doc[at], minlength=rows) if len(at) else np.zeros(rows, np.int64)
            first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            np.minimum.at(first, doc[at], at - words.offs[doc[at]])
            np.maximum.at(last, doc[at], at - words.offs[doc[at]])
            base = [set() for _ in range(rows)]
            for d, p in zip(doc[at].tolist(), label.tolist()):
                base[d].add(phrases[p][1])
            low = data.tobytes().lower()
            spans, scores, labels = [], [], []
            for d in range(rows):
                found = scanner.scan(low[offs[d] : offs[d + 1]].decode("utf-8", "replace"))
                spans.append([{"label": a, "start": b, "end": c, "edits": e} for a, b, c, e, _ in found])
                labels.append(",".join(sorted(base[d] | {f[0] for f in found})))
                scores.append(1.0 if base[d] else max((1 - e / n for _, _, _, e, n in found), default=0.0))
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, rows), pa.array(n_words, pa.int64()), pa.array(n_base, pa.int64()),
                    pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none),
                    pa.array([",".join(sorted(b)) for b in base]), pa.array(labels), pa.array(scores, pa.float64()), pa.array(spans, span),
                ],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<struct<label:string,start:bigint,end:bigint,edits:bigint>>"
    )
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), schema, start, step)
