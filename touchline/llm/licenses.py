"""License scans: fuzzy search for short notices.

A text becomes its words (lower-cased A-Z; runs of letters, digits and non-ASCII
characters), joined by one space.  A *place* of a notice is a run of whole words
within ``errors`` edits (insertions, deletions and substitutions of UTF-8 bytes)
of the notice's own words; the first ``fixed`` words of a notice must be there
unchanged, so that short names do not turn into other words.

A notice that allows k edits is split into k + 1 pieces.  Edits can spoil at most
k of them, so each place has one of the pieces exactly, shifted by k bytes at
most.  One automaton finds all pieces of all notices in one pass over the text;
each hit gives the few runs of words that begin and end where the piece allows.
The regex library then matches such a run against the notice with a bounded number
of errors, first none, then one more at a time, which gives its edits.  Runs whose
letters alone differ too much are not tried.

Of overlapping places of one notice, the one with the fewest edits is reported,
then the first, then the shortest.  ``score`` is the best similarity of a place:
1 less its edits per byte of the notice; 0 without a place.

Each text is scanned by itself: rows are neither moved nor gathered, and the
automaton is a few kilobytes in each task.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows are each reported; texts of any length are scanned whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from touchline.llm import frames, words as w


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    errors: int
    fixed: int = 0


# Phrases that must stand word by word, and their labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Short notices as licenses word them.
NOTICES = (
    Notice("mit", "mit license", 1, 1),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("apache", "apache license", 1, 1),
    Notice("apache", "you may not use this file except in compliance with the license", 4),
    Notice("gpl", "general public license", 2, 1),
    Notice("lgpl", "lesser general public license", 2, 1),
    Notice("agpl", "affero general public license", 2, 1),
    Notice("bsd", "bsd license", 1, 1),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    Notice("mpl", "mozilla public license", 2, 1),
    Notice("epl", "eclipse public license", 2, 1),
    Notice("cc", "creative commons attribution", 2, 1),
    Notice("cc", "licensed under cc by", 1),
    Notice("unlicense", "free and unencumbered software released into the public domain", 4),
)

LETTERS = b"abcdefghijklmnopqrstuvwxyz "

COLUMNS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
           "labels string, score double, places array<struct<label:string,notice:int,"
           "first_word:bigint,end_word:bigint,edits:int,start:bigint,end:bigint>>")


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """The text in ``errors`` + 1 pieces of nearly one size, and where they begin."""
    edges = [len(text) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:])]


class Search:
    """The notices, ready to be looked for (made in each task)."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.texts = [n.text.encode() for n in notices]
        self.letters = [[t.count(c) for c in LETTERS] for t in self.texts]
        # With the space after the fixed words, if more follow.
        self.fixed = [t if n.fixed >= len(t.split()) else
                      b"".join(x + b" " for x in t.split()[:n.fixed])
                      for t, n in zip(self.texts, notices)]
        self.patterns = [
            [regex.compile(b"(?:%s){e<=%d}" % (t, e)) for e in range(1, n.errors + 1)]
            for t, n in zip(self.texts, notices)]
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for at, piece in pieces(notice.text, notice.errors):
                owners.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, of in owners.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()

    def hits(self, line: bytes) -> dict[int, list[int]]:
        """By notice, where it would begin if nothing before its piece were edited."""
        out: dict[int, list[int]] = {}
        for last, (size, of) in self.automaton.iter(line.decode("latin-1")):
            for k, at in of:
                out.setdefault(k, []).append(last + 1 - size - at)
        return out

    def edits(self, k: int, run: bytes) -> int | None:
        """How many edits turn the notice into ``run``, if few enough."""
        if run == self.texts[k]:
            return 0
        gaps = [run.count(c) - n for c, n in zip(LETTERS, self.letters[k])]
        limit = self.notices[k].errors
        if sum(g for g in gaps if g > 0) > limit or -sum(g for g in gaps if g < 0) > limit:
            return None
        for e, pattern in enumerate(self.patterns[k], 1):
            if pattern.fullmatch(run):
                return e
        return None

    def places(self, line: bytes, every: bool = False) -> list[tuple[int, int, int, int]]:
        """(notice, first word, word after the last, edits), notice by notice:
        those that do not overlap, or every one."""
        hits = self.hits(line)
        if not hits:
            return []
        ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
        starts = np.concatenate(([0], ends[:-1] + 1))
        out = []
        for k, found in sorted(hits.items()):
            found, size, slack = np.unique(found), len(self.texts[k]), self.notices[k].errors
            # Words that begin within the slack of a hit.
            first = np.unique(np.concatenate([
                np.arange(a, b) for a, b in merged(
                    np.searchsorted(starts, found - slack),
                    np.searchsorted(starts, found + slack, "right"))] or [np.empty(0, int)]))
            tried = []
            for i in first.tolist():
                at = int(starts[i])
                if self.fixed[k] and not line.startswith(self.fixed[k], at):
                    continue
                a = int(np.searchsorted(ends, at + size - slack))
                b = int(np.searchsorted(ends, at + size + slack, "right"))
                for j in range(max(a, i), b):
                    e = self.edits(k, line[at:int(ends[j])])
                    if e is not None:
                        tried.append((e, i, j + 1))
            out += [(k, i, j, e) for e, i, j in (tried if every else apart(tried))]
        return out


def merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of ascending bounds, those that touch joined."""
    keep = high > low
    low, high = low[keep], high[keep]
    if not len(low):
        return []
    new = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1])))
    return list(zip(low[new].tolist(), high[np.append(new[1:], len(high)) - 1].tolist()))


def apart(tried: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The best of the places (edits, first, end) that do not overlap, in order."""
    taken: set[int] = set()
    kept = []
    for e, i, j in sorted(tried):
        if taken.isdisjoint(range(i, j)):
            taken.update(range(i, j))
            kept.append((e, i, j))
    return sorted(kept, key=lambda x: x[1])


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in the text, in code points."""
    body = np.frombuffer(w.spaced(text), np.uint8)
    inside = np.concatenate(([False], body != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    raw = np.frombuffer(text, np.uint8)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return before[edges[::2]], before[edges[1::2]]


def scan(text: bytes, base: Search, search: Search) -> tuple:
    """The values of ``COLUMNS`` for a text."""
    found = w.plain_words(text)
    line = b" ".join(found)
    exact, close = base.places(line, every=True), search.places(line)
    base_labels = {base.notices[k].label for k, *_ in exact}
    labels = base_labels | {search.notices[k].label for k, *_ in close}
    score = max([1.0 - e / len(search.texts[k]) for k, _, _, e in close], default=0.0)
    places = []
    if close:
        begins, ends = word_spans(text)
        places = [{"label": search.notices[k].label, "notice": k, "first_word": i, "end_word": j,
                   "edits": e, "start": int(begins[i]), "end": int(ends[j - 1])}
                  for k, i, j, e in close]
    first = [i for _, i, _, _ in exact]
    return (len(found), len(exact), min(first, default=None), max(first, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)),
            1.0 if exact else score, places)


def find_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 notices: tuple[Notice, ...] = NOTICES,
                 base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """One row per document: doc_id, the counts and labels, and all places.

    A base phrase is a notice that allows no edits: its only piece is itself.
    """
    exact = tuple(Notice(label, text, 0, len(text.split())) for label, text in base)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    ready: list[Search] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not ready:
            ready.extend((Search(exact), Search(notices)))
        rows = [scan(text, *ready) for text in frames.texts(batch)]
        return dict(zip(names, zip(*rows)))

    return frames.arrow_map(frames.keyed_texts(docs, id_col, text_col), work, COLUMNS, ("doc_id",))


def report(found: DataFrame) -> DataFrame:
    return found.drop("places")
