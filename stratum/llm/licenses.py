"""Operator 10: licence scan by template-markup matching.

A template is licence wording with markup: ``[[...]]`` may be left out, ``{{n}}`` stands for
up to n words of any kind. Each template compiles to an automaton over words whose arcs
are its mandatory words; optional regions are by-passes, replaceable regions are arcs that
take any word. A text is given the template's label when some run of its words is accepted,
so all mandatory wording must stand there exactly, in order and with nothing between.

Texts stay in their partition; the automata are a constant of the code.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from stratum.llm.common import read_table, text_of

#: Base phrases and their labels (fixed values of the query's contract).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_FSF = "[[as published by the free software foundation]] [[either]]"
_MIT_GRANT = ("permission is hereby granted free of charge to any person obtaining a copy of this software "
              "[[and associated documentation files]] [[the software]] to deal in the software without restriction "
              "including without limitation the rights to use copy modify merge publish distribute sublicense and or "
              "sell copies of the software and to permit persons to whom the software is furnished to do so")
_MIT_CONDITIONS = ("subject to the following conditions the above copyright notice and this permission notice "
                   "[[including the next paragraph]] shall be included in all copies or substantial portions of the software")
_MIT_DISCLAIMER = ("the software is provided as is without warranty of any kind express or implied including but not "
                   "limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
                   "in no event shall {{12}} be liable for any claim damages or other liability whether in an action of "
                   "contract tort or otherwise arising from out of or in connection with the software or the use or "
                   "other dealings in the software")
_BSD_GRANT = ("redistribution and use in source and binary forms with or without modification are permitted provided "
              "that the following conditions are met [[1]] [[a]] redistributions of source code must retain the above "
              "copyright notice this list of conditions and the following disclaimer [[2]] [[b]] redistributions in binary "
              "form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
              "the documentation and or other materials provided with the distribution")
_BSD_NAMES = ("neither the name of {{12}} nor the names of {{6}} contributors may be used to endorse or promote products "
              "derived from this software without specific prior written permission")
_BSD_DISCLAIMER = ("this software is provided by {{12}} as is and any express or implied warranties including but not "
                   "limited to the implied warranties of merchantability and fitness for a particular purpose are "
                   "disclaimed in no event shall {{12}} be liable for any direct indirect incidental special exemplary "
                   "or consequential damages including but not limited to procurement of substitute goods or services "
                   "loss of use data or profits or business interruption however caused and on any theory of liability "
                   "whether in contract strict liability or tort including negligence or otherwise arising in any way "
                   "out of the use of this software even if advised of the possibility of such damage")
#: Templates: label and marked-up wording.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]]"),
    ("gpl-3.0", "[[this work is]] licensed under the [[terms of the]] gnu general public license version 3 "
                "[[or any later version]]"),
    ("gpl-2.0", "[[this work is]] licensed under the [[terms of the]] gnu general public license version 2 "
                "[[or any later version]]"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0"),
    ("gpl-3.0", "gnu general public license as published by the free software foundation [[either]] version 3 of the license"),
    ("gpl-2.0", "gnu general public license as published by the free software foundation [[either]] version 2 of the license"),
    ("lgpl-3.0", f"gnu lesser general public license {_FSF} version 3"),
    ("lgpl-2.1", f"gnu lesser general public license {_FSF} version 2 1"),
    ("agpl-3.0", f"gnu affero general public license {_FSF} version 3"),
    ("mpl-2.0", "mozilla public license [[v]] [[version]] 2 0"),
    # a mere title does not state the licence: the text below it may be altered
    ("mit", "under the [[terms of the]] mit license"),
    ("isc", "under the [[terms of the]] isc license"),
    *[(f"bsd-{n}-clause", f"under the [[terms of the]] {form} license") for n, word in ((2, "simplified"), (3, "new"), (4, "original"))
      for form in (f"bsd {n} clause", f"{n} clause bsd", f"{word} bsd")],
    ("mit", f"{_MIT_GRANT} {_MIT_CONDITIONS} {_MIT_DISCLAIMER}"),
    ("mit-0", f"{_MIT_GRANT} {_MIT_DISCLAIMER}"),
    ("json", f"{_MIT_GRANT} {_MIT_CONDITIONS} the software shall be used for good not evil {_MIT_DISCLAIMER}"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies the software is "
            "provided as is and {{8}} disclaims all warranties with regard to this software including all implied "
            "warranties of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect "
            "or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
            "action of contract negligence or other tortious action arising out of or in connection with the use or "
            "performance of this software"),
    ("bsd-2-clause", f"{_BSD_GRANT} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{_BSD_GRANT} [[3]] [[c]] {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("bsd-4-clause", f"{_BSD_GRANT} [[3]] [[c]] all advertising materials mentioning features or use of this software must "
                     "display the following acknowledgement this product includes software developed by {{16}} "
                     f"[[4]] [[d]] {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("copyright-notice", "copyright {{8}} all rights reserved"),
)

#: Lower-cases A-Z and turns all that is no word character into a space.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
               for b in range(256))
_ANY = None


class Automaton:
    """Word automaton of one template: ``arcs[state]`` are (word or any, next state)."""

    def __init__(self, template: str):
        self.arcs: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        here, opened = 0, []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
            if part == "[[":
                opened.append(here)
            elif part == "]]":
                self.skips[opened.pop()].append(here)
            elif part.startswith("{{"):
                ends = []
                for _ in range(int(part[2:-2])):
                    ends.append(here)
                    here = self._arc(here, _ANY)
                for state in ends:
                    self.skips[state].append(here)
            else:
                here = self._arc(here, part.encode())
        self.accept = here
        self.first = {word for s in self._closed({0}) for word, _ in self.arcs[s]}

    def _arc(self, state: int, word: bytes | None) -> int:
        self.arcs.append([])
        self.skips.append([])
        self.arcs[state].append((word, len(self.arcs) - 1))
        return len(self.arcs) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def accepts_at(self, words: list[bytes], start: int) -> bool:
        """Whether some run of words from ``start`` is accepted; looks at no more than the template can take."""
        states = self._closed({0})
        for word in words[start:start + len(self.arcs)]:
            if self.accept in states:
                return True
            states = self._closed({nxt for s in states for need, nxt in self.arcs[s] if need is _ANY or need == word})
            if not states:
                return False
        return self.accept in states


@functools.lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]):
    """The automata, by the words they can begin with."""
    by_first: dict[bytes, list[tuple[str, Automaton]]] = {}
    for label, template in templates:
        automaton = Automaton(template)
        if _ANY in automaton.first:
            raise ValueError(f"template {label} must begin with a word")
        for word in automaton.first:
            by_first.setdefault(word, []).append((label, automaton))
    return by_first


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def scan(words: list[bytes], templates=TEMPLATES) -> tuple[list[tuple[int, str]], set[str]]:
    """Places of the base phrases (start, label), and the labels of accepted templates."""
    by_first = compiled(templates)
    phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in PHRASES:
        parts = phrase.encode().split()
        phrases.setdefault(parts[0], []).append((parts, label))
    wanted = by_first.keys() | phrases.keys()
    if wanted.isdisjoint(words):
        return [], set()
    places, labels = [], set()
    for i, word in enumerate(words):
        if word in wanted:
            places += [(i, label) for parts, label in phrases.get(word, ()) if words[i:i + len(parts)] == parts]
            labels |= {label for label, a in by_first.get(word, ()) if label not in labels and a.accepts_at(words, i)}
    return places, labels


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``labels`` are the base phrases' and the accepted templates' labels. ``score`` is 1 when
    a whole template is accepted, 0.5 when only a base phrase stands, else 0.

    Defined cases: null and empty texts have no words, no labels (empty strings) and null
    first and last word; a null id stays null; repeated rows give repeated results; an
    empty table gives an empty result; further columns are ignored.
    """
    ddl = (f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, "
           "last_word long, base_labels string, labels string, score double")

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                places, found = scan(words, templates)
                base = {label for _, label in places}
                rows.append((len(words), len(places), places[0][0] if places else None,
                             max(p for p, _ in places) if places else None, ",".join(sorted(base)),
                             ",".join(sorted(base | found)), 1.0 if found else 0.5 if base else 0.0))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    body = text_of(docs, text_col).cast("binary")
    return docs.select(docs[id_col].alias("doc_id"), body.alias("body")).mapInArrow(run, ddl)


def as_regex(template: str) -> str:
    """The template as a regular expression over `` word word ... `` (for the SQL check)."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        out += {"[[": "(?:", "]]": ")?"}.get(part) or (
            f"(?: [^ ]+){{0,{part[2:-2]}}}" if part.startswith("{{") else f" {part}")
    return out + " "


def op10_license_templates(spark, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT rid, label, i FROM (
        SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM w), (VALUES """ + ", ".join(
    f"({p.split()}, '{label}')" for p, label in PHRASES) + r""") AS phrase(parts, label)
      WHERE list_slice(words, i, i + len(parts) - 1) = parts),
b AS (SELECT rid, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word,
             list(DISTINCT label) AS base FROM p GROUP BY rid),
s AS (SELECT rid, doc_id, len(words) AS n_words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM w),
t AS (SELECT s.*, list_filter([""" + ", ".join(
    f"CASE WHEN regexp_matches(line, '{as_regex(t)}') THEN '{label}' END" for label, t in TEMPLATES) + r"""], lambda x: x IS NOT NULL) AS found
      FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), found))), ',') AS labels,
       CASE WHEN len(found) > 0 THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM t LEFT JOIN b USING (rid)
"""
