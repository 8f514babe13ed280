"""License scans by conditional compression.

A block is the text around what speaks of a license, over line ends, with room
for the longest template on either side; neighbouring blocks that touch are one,
and longer ones overlap.  Every template that a block has enough words of is
aligned with it, around every run of words that they share.  What is found there
is compressed alone and with the template as a raw Zstandard dictionary; the
template must save a good part of what it takes itself, whatever stands beside
it.  Versions and the names of licenses are obligatory: a notice that lacks one of
its template's, or has another name inside, is none.  All other words that were
added, dropped or replaced are reported.  Of confirmed notices that overlap the one with the most
words in common, less the differing ones, stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tickloom.llm.linededup import _texts

SAVED = 0.35  # least share of a template's own compressed size that it must save
ALIKE = 0.8  # least share of the template's words, in order, that the block must hold
LONGEST = 4096  # bytes of a block beside what it shares with the next one
# fixed values: wordings of license notices
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSD-3-Clause-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}
# fixed values: words that tell licenses of like wording apart, beside all words with a digit
NAMES = frozenset("mit apache mozilla lesser affero by by-sa by-nc by-nd by-nc-sa by-nc-nd".split())
# a block without any of these is no candidate
CUES = (b"licens", b"licenc", b"copyright", b"rights", b"permission", b"redistribut", b"public domain", b"free software")
_CUE = re.compile(b"|".join(map(re.escape, CUES)))
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_MARKS = re.compile(rb"(?m)^[\s*#/;%!|-]+")  # of comments, before a line's words


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def obligatory(words: list[str]) -> frozenset[str]:
    """The versions and names among a template's words; ``by`` is a name after ``cc`` alone."""
    named = {w for before, w in zip(["", *words], words) if w in NAMES and (w != "by" or before == "cc")}
    return frozenset(named | {w for w in words if any(c.isdigit() for c in w)})


@dataclass(frozen=True)
class Match:
    """A confirmed notice: its code points in a block, and how it differs from the template."""

    first: int
    last: int  # one past the last code point
    license: str
    saved: float
    wording: float
    differences: str
    score: int  # words in common less those added, dropped or replaced

    @property
    def rank(self) -> tuple:
        return -self.score, -self.wording, -self.saved, self.license, self.first


def apart(matches: list[Match]) -> list[Match]:
    """The best of the matches that overlap, in order."""
    chosen: list[Match] = []
    for m in sorted(set(matches), key=lambda m: m.rank):
        if all(m.last <= x.first or x.last <= m.first for x in chosen):
            chosen.append(m)
    return sorted(chosen, key=lambda m: m.first)


class Scanner:
    """The templates, ready to compress with."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = {name: _words(templates[name]) for name in self.names}
        self.must = {name: obligatory(self.words[name]) for name in self.names}
        self.bag = {name: Counter(self.words[name]) for name in self.names}
        self.matcher = {name: SequenceMatcher(None, [], self.words[name], autojunk=False) for name in self.names}
        # bytes on either side of a cue: a notice may be longer than its template, and its lines may have marks
        self.around = 64 + 2 * max((len(templates[name].encode()) for name in self.names), default=0)
        options = {"level": 19, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**options)
        self.given, self.size = {}, {}
        for name in self.names:
            body = templates[name].lower().encode()
            data = zstandard.ZstdCompressionDict(body.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = zstandard.ZstdCompressor(dict_data=data, **options)
            self.size[name] = len(self.alone.compress(body))

    def saved(self, notice: str, name: str) -> float:
        """The share of a template's own compressed size that it saves of a notice."""
        data = b" ".join(_MARKS.sub(b"", notice.lower().encode("utf-8", "replace")).split())
        return (len(self.alone.compress(data)) - len(self.given[name].compress(data))) / self.size[name]

    def confirm(self, text: str, name: str) -> tuple[float, str]:
        """(share of the template's words found in order, the exact differences around the match)."""
        have = _words(text)
        _, _, same, differences, _ = self._align(have, 0, len(have), name)
        return same / max(1, len(self.words[name])), differences

    def _align(self, have: list[str], lo: int, hi: int, name: str) -> tuple[int, int, int, str, bool]:
        """(first word, one past the last, words in common, differences, no obligatory word differs) in words lo to hi."""
        want, matcher, must, own = self.words[name], self.matcher[name], self.must[name], True
        matcher.set_seq1(have[lo:hi])
        codes = matcher.get_opcodes()
        same, first, last, out = 0, hi, lo, []
        for k, (tag, a, b, c, d) in enumerate(codes):
            if tag == "equal":
                same += b - a
            elif not must.isdisjoint(want[c:d]):
                own = False
            elif 0 < k < len(codes) - 1 and any(w in NAMES - {"by"} and w not in must for w in have[lo + a:lo + b]):
                own = False
            if tag != "equal" and k in (0, len(codes) - 1):
                # words before and after the notice are not its wording, but those in place of its own
                a, b = (max(a, b - (d - c)), b) if k == 0 else (a, min(b, a + (d - c)))
                if c == d:
                    continue
            if tag != "equal":
                out.append(f"[-{' '.join(want[c:d])}-]{{+{' '.join(have[lo + a:lo + b])}+}}")
            if b > a:
                first, last = min(first, lo + a), max(last, lo + b)
        return first, last, same, " ".join(out), own

    def _found(self, text: str, spans: list[tuple[int, int]], have: list[str], name: str) -> Iterator[Match]:
        """The template's notices in a block, around every run of words in common."""
        want, matcher = self.words[name], self.matcher[name]
        n, slack, parts = len(want), max(4, len(want) // 2), [(0, len(have))]
        while parts:
            lo, hi = parts.pop()
            if hi - lo < ALIKE * n:
                continue
            matcher.set_seq1(have)
            run = matcher.find_longest_match(lo, hi, 0, n)
            if run.size < min(n, 2):
                continue
            # where the notice must be if it holds this run
            a, b = max(lo, run.a - run.b - slack), min(hi, run.a + n - run.b + slack)
            first, last, same, differences, own = self._align(have, a, b, name)
            if own and same >= ALIKE * n:
                start, end = spans[first][0], spans[last - 1][1]
                # alone, as other notices beside it may hold the same words, and with the words around it
                saved = max(self.saved(text[start:end], name), self.saved(text[spans[a][0]:spans[b - 1][1]], name))
                if saved >= SAVED:
                    yield Match(start, end, name, saved, same / n, differences, same - (n - same) - (last - first - same))
            else:
                first, last = run.a, run.a + run.size
            parts += [(lo, first), (last, hi)]

    def matches(self, text: bytes) -> list[Match]:
        """All notices of a block, those that overlap too."""
        block = text.decode("utf-8", "ignore")
        spans = [m.span() for m in _WORD.finditer(block)]
        have = [block[a:b].lower() for a, b in spans]
        there = Counter(have)
        return [
            m
            for name in self.names
            if (there & self.bag[name]).total() >= ALIKE * len(self.words[name])
            for m in self._found(block, spans, have, name)
        ]

    def block(self, text: bytes) -> tuple[str, float, float, str] | None:
        """(license, share saved, wording, differences) of a block's best notice, or none."""
        best = min(self.matches(text), key=lambda m: m.rank, default=None)
        return best and (best.license, best.saved, best.wording, best.differences)

    def notices(self, text: bytes, known: dict[bytes, list[Match]]) -> list[tuple[int, int, Match]]:
        """(line, first code point, match) of the notices of a text that do not overlap."""
        out = []
        for at, end in blocks(text, self.around):
            block = text[at:end]
            if block not in known:
                if len(known) > 10_000:  # notices repeat; the memory for them is bounded
                    known.clear()
                known[block] = self.matches(block)
            if known[block]:
                before = len(text[:at].decode("utf-8", "ignore"))
                out.extend(replace(m, first=m.first + before, last=m.last + before) for m in known[block])
        if not out:
            return []
        whole = text.decode("utf-8", "ignore")
        return [(whole.count("\n", 0, m.first), m.first, m) for m in apart(out)]


def blocks(text: bytes, around: int) -> Iterator[tuple[int, int]]:
    """Byte spans of the candidate blocks of a text, from white space to white space.

    Blocks hold ``around`` bytes on either side of each cue; one that grows
    beyond LONGEST is followed by one that begins 2 ``around`` before its end,
    so that every notice is whole in one of them.
    """
    begin = end = -1

    def cut(a: int, b: int) -> Iterator[tuple[int, int]]:
        while b - a > LONGEST + 2 * around:
            yield a, _gap(text, a + LONGEST + 2 * around)
            a = _gap(text, a + LONGEST)
        yield a, b

    for m in _CUE.finditer(text.lower()):
        a, b = _gap(text, max(0, m.start() - around)), _gap(text, m.end() + around)
        if a <= end:
            end = max(end, b)
            continue
        if end >= 0:
            yield from cut(begin, end)
        begin, end = a, b
    if end >= 0:
        yield from cut(begin, end)


_SPACE = re.compile(rb"\s")


def _gap(text: bytes, at: int) -> int:
    """The first white space from a byte on, near it, or the next start of a character; 0 and the end are gaps."""
    if at <= 0 or at >= len(text):
        return min(max(at, 0), len(text))
    found = _SPACE.search(text, at, at + 200)
    if found:
        return found.start()
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, line, start, license, saved, wording, differences), one row for each notice.

    ``line`` counts from 0, ``start`` is the first code point of the notice in
    the text; notices of a document do not overlap.  Null and empty texts have no blocks; rows are scanned each for
    itself, repeated ones too, and a null doc_id stays null.  Of equal ranks the
    first template by name wins.  An empty table gives no rows; other columns
    are not read.
    """
    chosen = dict(TEMPLATES if templates is None else templates)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        known: dict[bytes, list[Match]] = {}
        for rows, texts in _texts(batches, "text"):
            owner, found = [], []
            for i, text in enumerate(texts):
                if not _CUE.search(text.lower()):
                    continue
                for line, start, m in scanner.notices(text, known):
                    owner.append(i)
                    found.append((line, start, m.license, m.saved, m.wording, m.differences))
            if found:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(owner, pa.int32()))]
                    + [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string()))],
                    ["doc_id", "line", "start", "license", "saved", "wording", "differences"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, line long, start long, license string, saved double, wording double, differences string"
    )
