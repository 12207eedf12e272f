"""License scans by template-markup matching.

A template is words with two kinds of markup: <<opt>> ... <</opt>> holds wording that may be left out, and <<var n>> stands
for 0 to n words of any kind (names, years, version numbers). compile_template() turns it into a token automaton: states are
places in the template, an edge reads one word (or any word inside a variable) and optional regions are skipped by empty
edges. A text is accepted from a start if some path reads words of it in order up to the final state, so all mandatory words
are there and stand in their order with nothing but optional or replaceable words between. Automata are only started at
words that can begin them, and documents without any template's anchor word are not scanned.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. Besides templates there are base phrases,
whose words must stand consecutively.

Edge cases: a null text equals the empty text (no words, empty labels, score 0); repeated rows and ids give a row each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows

# Phrases that the contract names, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License notices, headers of source files and whole texts as templates, label: markup.
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu @ general public license as published by the free software foundation either version <<var 2>> of the license or <<opt>>at your option<</opt>> any later version"
TEMPLATES = {
    "full-bsd-2": f"{_BSD} {_BSD_END}",
    "full-bsd-3": f"{_BSD} <<opt>>3<</opt>> neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    "full-isc": "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var 8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var 8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "full-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "header-agpl": _FREE.replace("@", "affero"),
    "header-apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<opt>>http<</opt>> <<opt>>https<</opt>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "header-cc": "this work is licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> creative commons attribution <<opt>>noncommercial<</opt>> <<opt>>sharealike<</opt>> <<opt>>noderivatives<</opt>> 4 0 international license",
    "header-gpl": _FREE.replace("@ ", ""),
    "header-lgpl": _FREE.replace("@", "lesser"),
    "header-mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<opt>>http<</opt>> <<opt>>https<</opt>> mozilla org mpl 2 0",
    "notice-apache": "licensed under the <<opt>>terms of the<</opt>> apache license <<opt>>version <<var 2>><</opt>>",
    "notice-cc": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc by <<opt>>nc<</opt>> <<opt>>sa<</opt>> <<opt>>nd<</opt>> 4 0",
    "notice-gpl": "this <<opt>>work<</opt>> <<opt>>program<</opt>> <<opt>>software<</opt>> is licensed under the <<opt>>terms of the<</opt>> <<opt>>gnu<</opt>> general public license <<opt>>version 3<</opt>>",
    "notice-mit": "released under the <<opt>>terms of the<</opt>> <<opt>>expat<</opt>> mit license",
    "text-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "text-bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "text-isc": "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted",
    "text-rights": "copyright <<opt>>c<</opt>> <<var 6>> all rights reserved",
}

_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MARK = re.compile(r"<<opt>>|<</opt>>|<<var (\d+)>>|[^\s<]+")


class Automaton:
    """Token automaton: edges[state] maps a word (None: any word) to states; skips[state] are empty edges."""

    def __init__(self, markup: str):
        self.edges: list[dict] = [{}]
        self.skips: list[set[int]] = [set()]
        opened: list[int] = []
        for m in _MARK.finditer(markup):
            at = len(self.edges) - 1
            if m[0] == "<<opt>>":
                opened.append(at)
            elif m[0] == "<</opt>>":
                self.skips[opened.pop()].add(at)
            elif m[1]:
                for _ in range(int(m[1])):
                    self._step(None)
                for s in range(at, at + int(m[1])):
                    self.skips[s].add(at + int(m[1]))
            else:
                self._step(m[0].encode())
        if opened:
            raise ValueError(f"an optional region stays open in {markup!r}")
        self.final = len(self.edges) - 1
        self.start = self.closed({0})
        self.first = {w for s in self.start for w in self.edges[s]}

    def _step(self, word: bytes | None) -> None:
        at = len(self.edges)
        self.edges[-1].setdefault(word, set()).add(at)
        self.edges.append({})
        self.skips.append(set())

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def accepts(self, words: list[bytes], at: int) -> int:
        """The end (exclusive) of the longest accepted run of words from at, or -1."""
        now, end, i = self.start, -1, at
        while now:
            if self.final in now:
                end = i
            if i >= len(words):
                break
            now = self.closed({t for s in now for w in (words[i], None) for t in self.edges[s].get(w, ())})
            i += 1
        return end


def compile_template(markup: str) -> Automaton:
    return Automaton(markup)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split()


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES):
        self.base = [(tuple(k.encode().split()), v) for k, v in base.items()]
        self.automata = {k: compile_template(v) for k, v in templates.items()}
        if any(None in a.first or a.final in a.start for a in self.automata.values()):
            raise ValueError("a template must begin with a mandatory word")
        self.starts: dict[bytes, list[str]] = {}
        for k, a in self.automata.items():
            for w in a.first:
                self.starts.setdefault(w, []).append(k)
        # a word that every accepted text has: the longest one outside optional and variable regions
        self.anchors = {}
        for k, v in templates.items():
            depth, found = 0, []
            for m in _MARK.finditer(v):
                depth += (m[0] == "<<opt>>") - (m[0] == "<</opt>>")
                if not depth and not m[0].startswith("<<"):
                    found.append(m[0].encode())
            self.anchors[k] = max(found, key=len)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """(number of words, base places (start, label), template matches (start, end, label))."""
        flat = (text or "").encode("utf-8", "surrogatepass").translate(_SPACES)
        words = flat.split()
        places = []
        for phrase, label in self.base:
            if all(w in flat for w in phrase):
                places += [(i, label) for i, w in enumerate(words) if w == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase]
        live = {k for k, w in self.anchors.items() if w in flat}
        spans = []
        if live:
            starts = {w: [k for k in ks if k in live] for w, ks in self.starts.items()}
            for i, w in enumerate(words):
                for k in starts.get(w, ()):
                    end = self.automata[k].accepts(words, i)
                    if end >= 0:
                        spans.append((i, end, k))
        return len(words), sorted(places), spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_template long, spans array<struct<start:long,stop:long,label:string>>"


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, with the base phrases, the accepted templates and their word spans.

    score is half for a base phrase and half for an accepted template."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, places, spans = scanner.scan(text)
                labels = {x for _, x in places}
                rows.append({"doc_id": doc, "n_words": n, "n_base": len(places), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None, "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {x[2] for x in spans})), "score": 0.5 * bool(places) + 0.5 * bool(spans), "n_template": len(spans), "spans": [{"start": s, "stop": e, "label": k} for s, e, k in spans]})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_template", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())])))])
