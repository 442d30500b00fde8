"""Operator 9: licence phrases, exact, and short notices with a bounded number of edits.

A text is lower-cased (A-Z) and cut into words of ASCII letters and digits and
of all non-ASCII bytes; words are joined by one space.

* Base phrases are found where their words stand consecutively.
* A notice of the table below may have up to ``k`` edits (insertions, deletions,
  substitutions of characters).  Split into k + 1 pieces, at least one piece is
  intact (pigeonhole): one Aho-Corasick pass finds all pieces, each hit sets a
  window around it, no longer than the notice and its edits, and the regex library's
  bounded-error matching verifies windows and reports span and edits.

Null and empty texts have no words, no labels and score 0.  The score is the
best certainty of any label: 1 for an exact phrase, 1 - edits / (k + 1) else.
Rows are taken one by one, so repeated rows and ids give repeated results, and
texts of any length are searched whole; of matches that overlap the one with
the fewest edits counts, of equals the first.  Columns other than the id and the
text aren't read, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import normalised_words, prepare

#: The phrases of the base, with labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices that are looked for with edits: (notice, label, most edits).
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under the apache license", "apache", 3),
    ("apache license version 2 0", "apache", 2),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("creative commons attribution", "cc-by", 3),
    ("all rights reserved", "proprietary", 2),
    ("this work is in the public domain", "public-domain", 3),
]
#: Each non-ASCII byte becomes one character, so an edit never breaks a character's bytes from each other unseen.
_CODEC = "latin-1"


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their places."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def places(pattern: regex.Pattern, text: str, windows: list[tuple[int, int]], least: int) -> list[regex.Match]:
    """Matches of a best-match pattern in any of some windows that don't overlap: the one with the fewest edits first, of equals the first.

    Each window is searched alone, and again in what is left of it where a better match
    takes a part, so the work follows the number of windows.  ``least``: characters of
    the shortest match.
    """
    waiting: list[tuple[int, int, int, int, int, regex.Match]] = []
    starts: list[int] = []  # of what is taken, in order, with its ends and matches
    taken: list[tuple[int, regex.Match]] = []

    def look(a: int, b: int) -> None:
        if b - a >= least and (m := pattern.search(text, a, b)):
            heapq.heappush(waiting, (sum(m.fuzzy_counts), m.start(), m.end(), a, b, m))

    for a, b in windows:
        look(a, b)
    while waiting:
        _, start, end, a, b, m = heapq.heappop(waiting)
        while waiting and waiting[0][:5] == (sum(m.fuzzy_counts), start, end, a, b):
            heapq.heappop(waiting)  # the same place again
        at = bisect.bisect_right(starts, start)
        if at and taken[at - 1][0] > start:
            at -= 1
        elif at == len(starts) or starts[at] >= end:
            starts.insert(at, start)
            taken.insert(at, (end, m))
            look(a, start)
            look(end, b)
            continue
        look(a, starts[at])
        look(taken[at][0], b)
    return [m for _, m in taken]


class Scanner:
    _one: "Scanner | None" = None

    def __init__(self, base: dict[str, str] = BASE, notices=NOTICES):
        import ahocorasick

        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base.items()]
        self.notices = notices
        self.patterns = [regex.compile(rf"(?b)(?<=\s)(?:{regex.escape(n)}){{e<={k}}}(?=\s)") for n, _, k in notices]
        # Each piece with the notices and places that it may stand for.
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _, k) in enumerate(notices):
            for at, piece in pieces(notice, k):
                found.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    @classmethod
    def one(cls) -> "Scanner":
        if cls._one is None:
            cls._one = cls()
        return cls._one

    def exact(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, words, label) of each place of a base phrase, in order."""
        text = b" " + b" ".join(words) + b" "
        out = []
        for phrase, label in self.base:
            at = text.find(phrase)
            while at >= 0:
                out.append((text.count(b" ", 0, at), phrase.count(b" ") - 1, label))
                at = text.find(phrase, at + 1)
        return sorted(out)

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice the windows that an intact piece points at; a match within k edits lies whole in one."""
        out: dict[int, dict[tuple[int, int], None]] = {}
        for end, (length, uses) in self.seeds.iter(text):
            for i, at in uses:
                notice, _, k = self.notices[i]
                start = end + 1 - length - at
                out.setdefault(i, {})[max(0, start - k - 1), min(len(text), start + len(notice) + k + 1)] = None
        return {i: list(spans) for i, spans in out.items()}

    def fuzzy(self, words: list[bytes]) -> list[tuple[int, int, int, str, int]]:
        """(first byte, end byte, edits, label, k) of notices in the joined words, spans in it."""
        text = " " + b" ".join(words).decode(_CODEC) + " "
        out = []
        for i, spans in self.windows(text).items():
            notice, label, k = self.notices[i]
            for m in places(self.patterns[i], text, spans, len(notice) - k):
                out.append((m.start() - 1, m.end() - 1, sum(m.fuzzy_counts), label, k))
        return sorted(out)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """One row per row of ``docs``: word and phrase counts, labels, score[, spans of fuzzy matches]."""
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    if spans:
        schema += ", spans array<struct<start:long,stop:long,edits:long,label:string>>"
        names.append("spans")
        kinds.append(pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int64()), ("label", pa.string())])))

    def run(batches):
        scanner = Scanner.one()
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                words = normalised_words(t)
                base, near = scanner.exact(words), scanner.fuzzy(words)
                own = {x[2] for x in base}
                every = own | {x[3] for x in near}
                best = 1.0 if base else max((1 - e / (k + 1) for _, _, e, _, k in near), default=0.0)
                starts = [x[0] for x in base]
                row = [len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(every)), best]
                if spans:
                    row.append([{"start": a, "stop": z, "edits": e, "label": label} for a, z, e, label, _ in near])
                rows.append(row)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select(doc_id, F.col(text).cast("binary")).mapInArrow(run, schema)
