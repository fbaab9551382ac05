"""Fuzzy search for short licence notices: pigeonhole seeds, then bounded-error matching; one label for each place."""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexgraph.llm.common import with_text
from lexgraph.session import ensure_importable

#: Phrases whose words stand consecutively, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of common licences as they stand in texts (normalised words), long and short, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "distributed under the mit license": "mit",
    "spdx license identifier mit": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "the above copyright notice and this permission notice shall be included": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "apache software license version 2 0": "apache-2",
    "spdx license identifier apache 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the bsd license": "bsd",
    "licensed under the 3 clause bsd license": "bsd",
    "licensed under the 2 clause bsd license": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "licensed under the isc license": "isc",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "released under the gpl": "gpl",
    "licensed under the gplv2": "gpl-2",
    "licensed under the gplv3": "gpl-3",
    "licensed under the gpl version 2": "gpl-2",
    "licensed under the gpl version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license version 2 0": "mpl-2",
    "subject to the terms of the mozilla public license": "mpl",
    "eclipse public license version 2 0": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "boost software license version 1 0": "boost",
    "the artistic license 2 0": "artistic",
    "licensed under the wtfpl": "wtfpl",
    "licensed under the zlib license": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "this work is in the public domain": "public-domain",
    "creative commons zero v1 0 universal": "cc0",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution 4 0 international": "cc-by",
    "open data commons open database license": "odbl",
    "sil open font license version 1 1": "ofl",
    "all rights reserved": "all-rights-reserved",
    "reproduction without permission is prohibited": "all-rights-reserved",
    "no part of this publication may be reproduced": "all-rights-reserved",
}
#: Every kind and version of the Creative Commons licences, and the kinds without a version.
_KINDS = ["by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd"]
NOTICES |= {f"licensed under cc {k} {v}": f"cc-{k} {v}".replace(" ", "-", k.count(" ") + 1).replace(" ", ".") for k in _KINDS for v in ("1 0", "2 0", "2 5", "3 0", "4 0")}
NOTICES |= {f"licensed under cc {k}": f"cc-{k}".replace(" ", "-") for k in _KINDS}
#: Words that tell one licence from another. They and all numbers must stand in a find as they are, those of over five letters with one edit at most.
TELLING = frozenset("mit apache spdx bsd isc gpl gplv2 gplv3 lesser library affero free documentation mozilla eclipse development distribution european boost artistic wtfpl zlib unencumbered domain zero cc cc0 by nc sa nd attribution noncommercial commercial sharealike alike noderivatives database sil clause permission reproduction publication rights".split())
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def seeds(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """``notice`` cut into edits + 1 pieces of nearly equal length, with their places.

    With at most ``edits`` changes, at least one piece is left whole.
    """
    n, k = len(notice), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(4)
def _plan(notices: tuple[tuple[str, str], ...], per_edit: int) -> tuple[list[tuple], ahocorasick.Automaton]:
    """The notices with their patterns and telling words, and one automaton of all their seeds."""
    plan, places = [], {}
    for k, (notice, label) in enumerate(notices):
        raw = notice.encode()
        edits = len(raw) // per_edit
        pattern = regex.compile(b"(?<![^ ])(?:" + regex.escape(raw) + b"){e<=%d}(?![^ ])" % edits, regex.BESTMATCH)
        plan.append((raw, label, edits, pattern, [w for w in raw.split() if w.decode(errors="replace") in TELLING or w.isdigit()]))
        for off, piece in seeds(raw, edits):
            places.setdefault(piece, []).append((k, off))
    found = ahocorasick.Automaton()
    for piece, at in places.items():
        # Bytes stand as characters of the same number, so places in both are the same.
        found.add_word(piece.decode("latin-1"), (len(piece), at))
    if places:
        found.make_automaton()
    return plan, found


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two words differ by one inserted, deleted or replaced byte at most."""
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return len(b) - len(a) <= 1 and (a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :] and len(a) == len(b) or a == b)


def tells(found: bytes, telling: list[bytes]) -> bool:
    """Whether all telling words stand in a find, in order."""
    words = iter(found.split())
    return all(any(w == t or (len(t) > 5 and not t.isdigit() and one_edit(w, t)) for w in words) for t in telling)


def _places(hay: bytes, needle: bytes) -> Iterator[int]:
    at = hay.find(needle)
    while at >= 0:
        yield at
        at = hay.find(needle, at + 1)


def _match(pattern: regex.Pattern, line: bytes, lo: int, hi: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match within lo and hi that ends at a word's end of ``line``."""
    while lo < hi and (m := pattern.search(line, lo, hi)):
        a, b = m.span()
        if b == len(line) or line[b : b + 1] == b" " or line[b - 1 : b] == b" ":
            return (sum(m.fuzzy_counts), a, b) if line[a:b].strip() else None
        hi = b - 1
    return None


def _best(pattern: regex.Pattern, line: bytes, windows: Iterable[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the matches within the windows, the best first; what overlaps a better one is sought again beside it."""
    queue = [(*m, lo, hi) for lo, hi in windows if (m := _match(pattern, line, lo, hi))]
    heapq.heapify(queue)
    taken: list[tuple[int, int]] = []
    out = []
    while queue:
        edits, a, b, lo, hi = heapq.heappop(queue)
        at = bisect.bisect_left(taken, (a, b))
        if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
            near = taken[max(at - 1, 0) : at + 2]
            cuts = sorted((x, y) for x, y in near if x < hi and y > lo)
            for x, y in zip([lo, *(y for _, y in cuts)], [*(x for x, _ in cuts), hi]):
                if (x, y) != (lo, hi) and (m := _match(pattern, line, x, y)):
                    heapq.heappush(queue, (*m, x, y))
            continue
        taken.insert(at, (a, b))
        out.append((edits, a, b))
    return out


def apart(finds: list[tuple]) -> list[tuple]:
    """Of finds (edits, -length, start, end, label) that overlap the best: fewest edits, then the longest notice, the first place, the label."""
    taken: list[tuple[int, int]] = []
    out = []
    for find in sorted(finds):
        a, b = find[2:4]
        at = bisect.bisect_left(taken, (a, b))
        if not ((at and taken[at - 1][1] > a + 1) or (at < len(taken) and taken[at][0] + 1 < b)):
            taken.insert(at, (a, b))
            out.append(find)
    return out


def scan(text: str, notices: tuple[tuple[str, str], ...] = tuple(NOTICES.items()), per_edit: int = CHARS_PER_EDIT) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int, float]]]:
    """(words, base places as (label, word), fuzzy spans as (label, first word, end word, edits, score)) of one whole text."""
    words = text.encode(errors="surrogatepass").translate(_TABLE).split()
    line = b" " + b" ".join(words) + b" "
    base, spans, starts = [], [], []

    def word_at(at: int) -> int:
        """The number of the word that starts at or holds ``at``."""
        if not starts:
            starts.extend(itertools.accumulate((len(w) + 1 for w in words), initial=1))
        return bisect.bisect_right(starts, at) - 1

    for phrase, label in BASE.items():
        base += [(label, word_at(at + 1)) for at in _places(line, b" " + phrase.encode() + b" ")]
    plan, automaton = _plan(notices, per_edit)
    windows: dict[int, set[tuple[int, int]]] = {}
    for end, (size, listed) in automaton.iter(line.decode("latin-1")) if plan else ():
        for k, off in listed:
            at = end + 1 - size - off
            raw, _, edits, _, _ = plan[k]
            windows.setdefault(k, set()).add((max(0, at - edits - 1), min(len(line), at + len(raw) + edits + 1)))
    finds = []
    for k, own in windows.items():
        raw, label, _, pattern, telling = plan[k]
        finds += [(used, -len(raw), a, b, label) for used, a, b in _best(pattern, line, own) if tells(line[a:b], telling)]
    for used, less, a, b, label in apart(finds):
        found = line[a:b].strip()
        first = word_at(a + (line[a : a + 1] == b" "))
        spans.append((label, first, first + found.count(b" ") + 1, used, 1 + used / less))
    return len(words), base, spans


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Find licence notices in every whole text.

    Returns doc_id, n_words, n_base (places of the base phrases), first_word and
    last_word (their least and greatest start; null without any), base_labels and
    labels (distinct, sorted, comma-joined; labels holds the base ones too), score
    (1 for a base phrase, else the best of 1 - edits / characters of the notice found, 0
    without a find) and spans (label, first_word, end_word, edits) of the fuzzy
    search, in order of place. A find must hold the notice's telling words (TELLING);
    where finds overlap, of one notice or of several, the one with the fewest edits
    stays, then the longest notice, so a place has one label. Null and empty texts have no words and empty
    labels; repeated rows and null ids give a row each.
    """
    ensure_importable(docs.sparkSession)
    listed = tuple((notices or NOTICES).items())
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, base, spans = scan(value.as_py() or "", listed, per_edit)
                starts = [w for _, w in base]
                own = {x for x, _ in base}
                score = 1.0 if base else max((s[4] for s in spans), default=0.0)
                rows.append((doc_id, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), score, [dict(zip(("label", "first_word", "end_word", "edits"), s)) for s in sorted({s[:4] for s in spans}, key=lambda s: (s[1], s[2], s[0], s[3]))]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)] if rows else [pa.array([], f.type) for f in fields], schema=fields)

    return with_text(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,edits:int>>")
