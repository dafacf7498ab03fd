"""License scanning: plain phrases, and license templates as token automata.

A template is text with markup: ``[[ ... ]]`` is optional, ``{{n}}`` stands for
at most n words of any kind, the rest is mandatory. ``compile_template`` turns
it into an automaton whose states are positions in the mandatory wording and
whose edges consume one word each, or none; running it is a subset simulation,
linear in the words read. A text is accepted where some run consumes all
mandatory words in order, without any other word in between than markup allows.

Scanning happens per Arrow batch on UTF-8 bytes. Words are ASCII letters
(A-Z lower-cased), digits, and all non-ASCII characters. Only texts that hold a
template's anchor, its first mandatory words (up to four in a row), run its automaton.

Defined cases: a null or empty text has no words, no labels and score 0; a very
long text is scanned whole; templates that overlap (ties) each give their label, and
one label counts once however often it stands; repeated rows give equal results; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, NOT_WORD, arrow_map, table, text_buffer, words

NAME = "op1_license_scan"
#: Phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: Parts of license texts.
MIT_DISCLAIMER = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
ISC_GRANT = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies"
ISC_DISCLAIMER = "the software is provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
BSD_CONDITIONS = "[[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_NAMES = "[[3]] [[c]] neither the name of {{12}} nor the names of [[its]] [[the]] contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_DISCLAIMER = "this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
#: Whole licenses and notices, in the markup above; those that end in -grant are the first sentence of a license only.
TEMPLATES = {
    "mit-text": f"{MIT_GRANT} and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software {MIT_DISCLAIMER}",
    "isc-text": f"{ISC_GRANT} {ISC_NOTICE} {ISC_DISCLAIMER}",
    "0bsd-text": f"{ISC_GRANT} {ISC_DISCLAIMER}",
    "bsd-2-text": f"{BSD_GRANT} {BSD_CONDITIONS} {BSD_DISCLAIMER}",
    "bsd-3-text": f"{BSD_GRANT} {BSD_CONDITIONS} {BSD_NAMES} {BSD_DISCLAIMER}",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    "unlicense-text": f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {MIT_DISCLAIMER}",
    "apache-2.0-notice": "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the license at {{10}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-notice": "[[this program is free software]] you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation either version {{2}} of the license or at your option any later version",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{8}}",
    "mit-grant": MIT_GRANT,
    "isc-grant": f"{ISC_GRANT} {ISC_NOTICE}",
    "bsd-grant": BSD_GRANT,
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
    "mpl-2.0-grant": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mit-notice": "[[licensed]] [[released]] [[distributed]] under the [[terms of the]] mit license",
    "apache-2.0-short": "licensed under the apache license [[version]] 2 0",
    "gpl-3.0-short": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] version 3",
    "gpl-either-version": "either version {{2}} of the license or at your option any later version",
    "cc-by-4.0": "licensed under [[a]] [[the]] cc by 4 0",
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] cc by sa 4 0",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] cc by nc 4 0",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied",
}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """States 0..n; state n accepts. steps[i] = (word or None for any, may be skipped up to)."""

    def __init__(self, template: str):
        parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template)
        self.words: list[bytes | None] = []
        jumps: list[tuple[int, int]] = []
        opened: list[int] = []
        mandatory: list[int] = []
        for x in parts:
            if x == "[[":
                opened.append(len(self.words))
            elif x == "]]":
                jumps.append((opened.pop(), len(self.words)))
            elif x.startswith("{{"):
                for _ in range(int(x[2:-2])):
                    jumps.append((len(self.words), len(self.words) + 1))
                    self.words.append(None)
            else:
                if not opened:
                    mandatory.append(len(self.words))
                self.words.append(x.encode())
        self.mandatory = set(mandatory)
        #: Mandatory words before each state.
        self.done = [sum(k < state for k in mandatory) for state in range(len(self.words) + 1)]
        self.free: list[tuple[int, ...]] = []
        for state in range(len(self.words) + 1):
            reached, todo = {state}, [state]
            while todo:
                at = todo.pop()
                for a, b in jumps:
                    if a == at and b not in reached:
                        reached.add(b)
                        todo.append(b)
            self.free.append(tuple(sorted(reached)))
        first = mandatory[0]
        row = next(n for n in range(1, 5) if n == 4 or first + n not in self.mandatory)
        #: Mandatory words in a row that every accepted text holds, and the words before them that markup may add.
        self.anchor, self.before = self.words[first : first + row], first

    def run(self, text: list[bytes], at: int) -> tuple[bool, int]:
        """Whether words from position at on are accepted, and the mandatory words consumed at best."""
        states, best = set(self.free[0]), 0
        last = len(self.words)
        while True:
            if last in states:
                return True, len(self.mandatory)
            if at >= len(text):
                return False, best
            word, moved = text[at], set()
            for s in states:
                if s < last and (self.words[s] is None or self.words[s] == word):
                    moved.update(self.free[s + 1])
            if not moved:
                return False, best
            states, at = moved, at + 1
            best = max(best, self.done[max(states)])


def templates_in(text: bytes, automata: dict[str, Automaton]) -> tuple[list[str], float]:
    """Labels of accepted templates in lower-cased bytes, and the largest share of mandatory words matched."""
    labels, share, tokens = [], 0.0, None
    for label, auto in automata.items():
        if auto.anchor[0] not in text or auto.anchor[-1] not in text:
            continue
        tokens = WORD.findall(text) if tokens is None else tokens
        n, first = len(auto.anchor), auto.anchor[0]
        k = -1
        while True:
            try:
                k = tokens.index(first, k + 1)
            except ValueError:
                break
            if tokens[k : k + n] != auto.anchor:
                continue
            for begin in range(max(0, k - auto.before), k + 1):
                done, got = auto.run(tokens, begin)
                share = max(share, got / len(auto.mandatory))
                if done:
                    labels.append(label)
                    break
            if label in labels:
                break
    return labels, share


def phrase_pattern(phrase: tuple[str, ...]) -> re.Pattern:
    between = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
    return re.compile(rb"(?<![0-9a-z\x80-\xff])" + (between + rb"+").join(x.encode() for x in phrase) + rb"(?![0-9a-z\x80-\xff])")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict | None = None, templates: dict | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    score is 1 where a template is accepted, otherwise half the largest share of
    a template's mandatory words, and at least 0.5 where a phrase stands.
    """
    plain = [(phrase_pattern(p), p[-1].encode(), label) for p, label in (phrases or PHRASES).items()]
    automata = {label: Automaton(t) for label, t in (templates or TEMPLATES).items()}
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batch):
        data, offsets = text_buffer(batch.column(1))
        data = LOWER[data]
        starts, _, first = words(data, offsets, NOT_WORD)
        raw = data.tobytes()
        cols: list[list] = [[] for _ in kinds]
        for k in range(batch.num_rows):
            low, high = int(offsets[k]), int(offsets[k + 1])
            text = raw[low:high]
            places, base = [], set()
            for pattern, last, label in plain:
                for m in pattern.finditer(text) if last in text else ():
                    places.append(int(np.searchsorted(starts, low + m.start())) - int(first[k]))
                    base.add(label)
            found, share = templates_in(text, automata)
            score = 1.0 if found else max(share / 2, 0.5 if places else 0.0)
            for col, value in zip(cols, (int(first[k + 1] - first[k]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), score), strict=True):
                col.append(value)
        yield pa.record_batch([batch.column(0), *map(pa.array, cols, kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: 1 where a template is accepted, 0.5 where a phrase alone stands, else 0."""
    found = scan(table(spark, sf_dir, "documents"))
    graded = F.when(F.col("score") == 1.0, 1.0).when(F.col("n_base") > 0, 0.5).otherwise(0.0)
    return found.withColumn("score", graded)


def as_pattern(template: str) -> str:
    """A template as a regular expression over words that are each followed by a space."""
    out = ""
    for x in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        out += {"[[": "(?:", "]]": ")?"}.get(x) or (f"(?:[^ ]+ ){{0,{x[2:-2]}}}" if x[0] == "{" else f"{x} ")
    return f"(?:^| ){out}"


def sql() -> str:
    places = [f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {' and '.join(f'w[i + {k}] = {x!r}' for k, x in enumerate(phrase))}), lambda i: {{'at': i - 1, 'label': {label!r}}})" for phrase, label in PHRASES.items()]
    accepted = ", ".join(f"case when regexp_matches(plain, {as_pattern(t)!r}) then {label!r} end" for label, t in TEMPLATES.items())
    return f"""
with split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
found as (
  select doc_id, len(w) as n_words, list_concat({places[0]}, list_concat({places[1]}, {places[2]})) as base, array_to_string(w, ' ') || ' ' as plain
  from split),
named as (
  select *, list_distinct(list_transform(base, lambda x: x.label)) as base_labels, list_filter([{accepted}], lambda x: x is not null) as accepted
  from found)
select doc_id, n_words, len(base) as n_base, list_min(list_transform(base, lambda x: x.at)) as first_word, list_max(list_transform(base, lambda x: x.at)) as last_word,
  coalesce(array_to_string(list_sort(base_labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base_labels, accepted))), ','), '') as labels,
  cast(case when len(accepted) > 0 then 1.0 when len(base) > 0 then 0.5 else 0.0 end as double) as score
from named
"""


SQL = sql()
