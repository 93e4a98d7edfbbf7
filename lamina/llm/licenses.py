"""License scans: exact phrases, and fuzzy search for short notices.

A notice that may differ by k edits is cut into k + 1 pieces: at least one stands unchanged in any
match (pigeonhole). Exact search for the pieces finds candidate places; the regex library's
bounded-error matching verifies the edits there and gives the span.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, as_bytes, map_batches

# Base phrases and labels.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Short notices (label, words, edits allowed in characters).
NOTICES = (
    ("apache", "licensed under the apache license version 2 0", 4),
    ("apache", "http www apache org licenses license 2 0", 4),
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("mit", "the software is provided as is without warranty of any kind", 5),
    ("gpl", "under the terms of the gnu general public license", 5),
    ("gpl", "gnu general public license as published by the free software foundation", 6),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    ("mpl", "subject to the terms of the mozilla public license", 5),
    ("cc", "licensed under a creative commons attribution", 4),
    ("proprietary", "all rights reserved unauthorized copying", 4),
)


#: Where the allowed edits could change a licence's name into another's: the name, held to one edit.
NAMES = {"released under the mit license": regex.compile(rb"(?:mit){e<=1}")}


@dataclass(frozen=True)
class Notice:
    label: str
    text: bytes
    edits: int
    pieces: tuple[tuple[int, bytes], ...]
    grams: tuple[bytes, ...]
    pattern: regex.Pattern
    name: regex.Pattern | None


@lru_cache(maxsize=4)
def compiled(notices: tuple = NOTICES) -> tuple[Notice, ...]:
    """Notices with their pieces (place, bytes), runs of three bytes and bounded-error patterns."""
    out = []
    for label, words, k in notices:
        b = words.encode()
        cuts = [len(b) * i // (k + 1) for i in range(k + 2)]
        pieces = tuple((a, b[a:z]) for a, z in zip(cuts, cuts[1:], strict=False))
        grams = tuple(sorted({b[i : i + 3] for i in range(len(b) - 2)}))
        out.append(Notice(label, b, k, pieces, grams, regex.compile(b"(?be)(?:" + regex.escape(b) + b"){e<=%d}" % k), NAMES.get(words)))
    return tuple(out)


def places(haystack: bytes, needle: bytes, step: int = 1) -> Iterator[int]:
    at = haystack.find(needle)
    while at >= 0:
        yield at
        at = haystack.find(needle, at + step)


def fuzzy_spans(norm: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice in word-normalised text, apart from each other, in order.

    Every piece of the notice is looked up exactly; each place bounds a window of the notice's length
    and the allowed edits on either side, and windows that start within a notice's length are one. Of all
    windows' best matches that with the fewest edits is taken first (then the earliest); a window that it reaches into is searched again before and
    behind it. So windows are short however often the notice stands, and no place is lost: each
    stretch within the allowed edits meets a span.
    """
    size, k, end = len(notice.text), notice.edits, len(norm)
    least = len(notice.grams) - 3 * k  # an edit touches three runs of three bytes at most
    waiting: list[tuple[int, int, int, int, int]] = []  # edits, span, window

    def look(a: int, z: int) -> None:
        if z - a < size - k:
            return
        part = norm[a:z]
        if sum(g in part for g in notice.grams) < least:
            return
        m = notice.pattern.search(norm, a, z)
        if m and m.end() > m.start():
            heapq.heappush(waiting, (sum(m.fuzzy_counts), m.start(), m.end(), a, z))

    starts = sorted({at - place for place, piece in notice.pieces for at in places(norm, piece)})
    first = 0
    for i, s in enumerate(starts):
        if i + 1 == len(starts) or starts[i + 1] - starts[first] > size:
            look(max(0, starts[first] - k), min(end, s + size + k))
            first = i + 1
    taken: list[tuple[int, int, int]] = []
    while waiting:
        edits, start, stop, a, z = heapq.heappop(waiting)
        i = bisect_left(taken, (start,))
        over = [t for t in taken[max(0, i - 1) : i + 2] if t[0] < stop and start < t[1]]
        if over:
            start, stop = over[0][0], over[-1][1]
        elif notice.name is None or notice.name.search(norm, start, stop):
            taken.insert(i, (start, stop, edits))
        look(a, start)
        look(stop, z)
    return taken


def word_numbers(norm: bytes) -> Callable[[int], int]:
    """Place in the text -> words begun before it; the spaces are counted once, when first asked for."""
    spaces: list[np.ndarray] = []

    def number(at: int) -> int:
        if not spaces:
            spaces.append(np.flatnonzero(np.frombuffer(norm, np.uint8) == 0x20))
        return int(np.searchsorted(spaces[0], at))

    return number


def scan_text(text: bytes, notices: tuple[Notice, ...] | None = None) -> dict:
    """One text's words, base places, labels, notice spans (in words) and score."""
    notices = compiled() if notices is None else notices
    words = text.translate(ALNUM_TABLE).split()
    norm = b" " + b" ".join(words) + b" "
    number = word_numbers(norm)
    found = [(number(at), label) for phrase, label in BASE for at in places(norm, b" " + phrase.encode() + b" ")]
    base = {label for _, label in found}
    labels, spans, score = set(base), [], 1.0 if base else 0.0
    for n in notices:
        for a, z, edits in fuzzy_spans(norm, n):
            labels.add(n.label)
            spans.append((n.label, number(a + 1) - 1, number(z) - 1, edits))
            score = max(score, 1.0 - edits / (2.0 * (n.edits + 1)))
    return {
        "n_words": len(words), "n_base": len(found), "first_word": min((w for w, _ in found), default=None), "last_word": max((w for w, _ in found), default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "spans": spans,
    }


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
)


def license_scan(documents: DataFrame, notices: tuple = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: words, exact phrase places, labels of both methods, notice spans, score.

    Score: 1 with a base phrase; else 1 - edits / (2 * (allowed + 1)) of the best notice; 0 with none.

    spans: the notices' places, apart from each other for one notice, as first and last word (from 0) and edits.

    Defined cases: a null text is empty (0 words, empty labels, score 0, no spans); null and repeated ids are
    kept; an empty table gives no rows; other columns are not looked at. Whole texts are scanned, in time
    in proportion to their length.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = compiled(notices)
        for batch in it:
            got = [scan_text(t, own) for t in as_bytes(batch.column("text"))]
            out = {name: [g[name] for g in got] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            out["spans"] = [[{"label": a, "first_word": b, "last_word": c, "edits": e} for a, b, c, e in g["spans"]] for g in got]
            yield out | {"doc_id": batch.column("doc_id")}

    return map_batches(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)
