"""License notices in texts, by conditional compression."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import slices

# The usual short notices, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT-short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Whole licences, up to the end of their terms. Added as ``<name>-text``.
TEMPLATES |= {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Words around these are looked at, whatever stands between them.
CUES = ("licen", "permission is hereby", "redistribution and use", "copyright", "free software", "public domain")

_WORD = re.compile(r"[A-Za-z0-9]+(?:[.+-][A-Za-z0-9]+)*")
RESULT = (
    "template string, start bigint, end bigint, plain_bytes int, dictionary_bytes int, reduction double,"
    " runner_up string, missing string, replaced string, confirmed boolean"
)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _pattern(phrases) -> re.Pattern:
    return re.compile("|".join("[^a-z0-9]+".join(re.escape(w) for w in p.split()) for p in phrases))


class Scanner:
    """Finds templates in texts: whole ones by their words, altered ones by what each, as raw dictionary, saves."""

    def __init__(self, templates: dict[str, str]):
        self.templates = templates
        self.words = {name: words_of(text) for name, text in templates.items()}
        self.joined = {name: f" {' '.join(words)} " for name, words in self.words.items() if words}
        cues = _pattern(CUES)
        # A template without a cue is looked for by its first words.
        own = [" ".join(self.words[name][:3]) for name, text in self.joined.items() if not cues.search(text)]
        self.cues = _pattern([*CUES, *own])
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
        self.with_template = {}
        for name, text in templates.items():
            body = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            body.precompute_compress(level=19)
            self.with_template[name] = zstandard.ZstdCompressor(level=19, write_content_size=False, dict_data=body)
        self.seen: dict[tuple, int] = {}
        self.most = {name: max(1, self._saved(name, text)) for name, text in templates.items()}
        # Where each template holds each cue, as the first and the last word with it.
        self.places: dict[str, dict[str, tuple[int, int]]] = {}
        for name, text in self.joined.items():
            held: dict[str, list[int]] = {}
            starts = _starts(self.words[name])
            for m in self.cues.finditer(text):
                held.setdefault(_cue(m), []).append(bisect_right(starts, m.start()) - 1)
            self.places[name] = {cue: (min(at), max(at)) for cue, at in held.items()}

    def _size(self, name: str | None, block: str) -> int:
        """Compressed bytes of a block, plain or with a template as dictionary."""
        if len(block) > 4096:
            return len((self.with_template[name] if name else self.plain).compress(block.encode()))
        if (name, block) not in self.seen:
            if len(self.seen) >= 1 << 14:
                self.seen.clear()
            self.seen[name, block] = len((self.with_template[name] if name else self.plain).compress(block.encode()))
        return self.seen[name, block]

    def _saved(self, name: str, block: str) -> int:
        return self._size(None, block) - self._size(name, block)

    def notices(self, text: str):
        """``(start, end, template, plain, size, reduction, runner up, missing, replaced, confirmed)`` by start."""
        if not self.cues.search(text.lower()):
            return []
        marks = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in marks]
        starts, joined = _starts(words), f" {' '.join(words)} "
        # Every whole template, but for those within the words of a longer one.
        whole = []
        for name, wanted in self.joined.items():
            at = joined.find(wanted)
            while at >= 0:
                first = bisect_left(starts, at + 1)
                whole.append((first, first + len(self.words[name]), name))
                at = joined.find(wanted, at + 1)
        whole.sort(key=lambda w: (w[0], -w[1], w[2]))
        kept = []
        for first, end, name in whole:
            if not kept or end > kept[-1][1] or (first, end) == kept[-1][:2]:
                kept.append((first, end, name))
        rows, known = [], {}
        for first, end, name in kept:
            others = self._ranked(marks, text, {n: (first, end) for n in self.joined if n != name}, known)
            rows.append(self._row(marks, text, name, first, end, others[0] if others else None, [], []))
        # Cues outside of them, each with the words around it that a template aligned with it would take.
        bounds = [(first, end) for first, end, _ in kept]
        at, altered = 0, []
        for m in self.cues.finditer(joined):
            i = bisect_right(starts, m.start()) - 1
            while at < len(bounds) and bounds[at][1] <= i:
                at += 1
            if at < len(bounds) and bounds[at][0] <= i:
                continue
            low = bounds[at - 1][1] if at else 0
            high = bounds[at][0] if at < len(bounds) else len(words)
            areas = {}
            for name in self.joined:
                n = len(self.words[name])
                near, far = self.places[name].get(_cue(m), (0, n - 1))
                slack = 2 + n // 8
                # Areas of long templates begin and end at multiples of half their length, so that cues share them.
                grid = n // 2 if n >= 64 else 1
                first, end = (i - far - slack) // grid * grid, -(-(i - near + n + slack) // grid) * grid
                areas[name] = (max(low, first), min(high, end))
            altered.append((i, *self._best(marks, text, words, areas, known)))
        best: dict[str, tuple] = {}
        out = []
        for i, share, name, first, end, row in altered:
            # Cues that stand in each other's block for the same template are of one notice.
            last = best.get(name)
            if last and last[2] <= i < last[3] and first <= last[0] < end:
                if share <= last[1]:
                    continue
                out[last[4]] = row
                best[name] = (i, share, first, end, last[4])
            else:
                best[name] = (i, share, first, end, len(out))
                out.append(row)
        rows += out
        return sorted(rows, key=lambda r: r[:3])

    def _row(self, marks, text, name, first, end, runner_up, missing, replaced):
        block = text[marks[first][0] : marks[end - 1][1]]
        plain, size = self._size(None, block), self._size(name, block)
        confirmed = not missing and not replaced
        return marks[first][0], marks[end - 1][1], name, plain, size, 1 - size / plain, runner_up, " ".join(missing), ", ".join(replaced), confirmed

    def _ranked(self, marks, text, areas, known) -> list[str]:
        """Templates by the part of the bytes they can save that they save on their words, then by name."""
        for n, (a, b) in areas.items():
            if (n, a, b) not in known:
                known[n, a, b] = self._saved(n, text[marks[a][0] : marks[b - 1][1]]) / self.most[n]
        return sorted(areas, key=lambda n: (-known[(n, *areas[n])], n))

    def _best(self, marks, text, words, areas, known):
        name, *others = self._ranked(marks, text, areas, known)
        first, end = areas[name]
        if (first, end, name) not in known:
            own = words[first:end]
            missing, replaced = self._differences(name, own)
            row = self._row(marks, text, name, first, end, others[0] if others else None, missing, replaced)
            known[first, end, name] = self._shared(name, own), row
        share, row = known[first, end, name]
        return share, name, first, end, row

    def _shared(self, name: str, own: list[str]) -> float:
        matcher = difflib.SequenceMatcher(None, self.words[name], own, autojunk=False)
        return sum(b.size for b in matcher.get_matching_blocks()) / max(1, len(self.words[name]))

    def _differences(self, name: str, own: list[str]) -> tuple[list[str], list[str]]:
        """Template words that the block lacks, and those it has others for; words around the notice don't count."""
        missing, replaced = [], []
        matcher = difflib.SequenceMatcher(None, self.words[name], own, autojunk=False)
        codes = matcher.get_opcodes()
        for k, (kind, a, b, c, d) in enumerate(codes):
            inside = 0 < k < len(codes) - 1
            if kind == "delete":
                missing += self.words[name][a:b]
            elif kind == "replace":
                # Where the notice begins or ends, only as many words as the template has there.
                if k == 0:
                    c = max(c, d - (b - a))
                elif k == len(codes) - 1:
                    d = min(d, c + (b - a))
                replaced.append(f"{' '.join(self.words[name][a:b])} -> {' '.join(own[c:d])}")
            elif kind == "insert" and inside:
                replaced.append(f" -> {' '.join(own[c:d])}")
        return missing, replaced


def _starts(words: list[str]) -> list[int]:
    """Where each word begins in the words joined by spaces, with one before them."""
    out, at = [], 1
    for word in words:
        out.append(at)
        at += len(word) + 1
    return out


def _cue(match: re.Match) -> str:
    return re.sub("[^a-z0-9]+", " ", match.group())


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per license notice, or words that may be one: ``key`` and the columns of ``RESULT``.

    Words are compared across line ends and punctuation, over the whole text. Every place with
    a template's whole wording gives a ``confirmed`` row, unless a longer template found there
    includes it. Every further one of ``CUES`` is judged with the words around it, up to
    confirmed ones: for each template as many as it can reach over when aligned with the cue.
    The template that saves the largest part of the bytes it can save as raw dictionary wins;
    ``missing`` and ``replaced`` name the differences. Cues in one such block give one row.
    ``start`` and ``end`` are code points of the block in the text. Null and empty texts have
    no blocks.
    """
    templates = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        scanner = Scanner(templates)
        names = [p.split()[0] for p in RESULT.split(",")]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        for part in slices(batches, text):
            rows, found = [], []
            for row, value in enumerate(part.column(text).to_pylist()):
                for start, end, best, *rest in scanner.notices(value):
                    rows.append(row)
                    found.append((best, start, end, *rest))
            columns = list(zip(*found, strict=True)) if found else [()] * 10
            keys = part.column(key).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {RESULT}")
