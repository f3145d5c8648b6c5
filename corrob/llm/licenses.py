"""License scans: known sentences to identifiers, identifier sequences to licences.

A text is cut into pieces (at line ends and after . ; : ! ? before a blank),
whose words (lower case, without signs) are matched against the known licence
sentences.  A known sentence begins where a piece begins and ends where a piece
ends, and may run over line ends (wrapped lines, with or without comment signs)
but not over a blank line, a list item or one of the signs above; an address
after a blank line still belongs to the sentence before.  Of several that fit
the longest counts.  Copyright holders and years are left out.

The identifiers of a text, in order, are then matched against ordered rules: a
rule fits where its identifiers follow each other with at most GAP sentences
between two of them (a line shorter than WRAPPED ends one).  Longer rules go
first, and a sentence is used once.

A pass over the texts without a shuffle; texts without one of a few key words
are left alone.

Defined cases: a null or empty text has no licence; repeated rows are each
reported; an empty table gives an empty result; other columns are not looked
at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from corrob.session import ship_package

GAP = 6
WRAPPED = 40  # characters of a line that may go on in the next
HOLDER = 12  # words a holder's name may have
#: Identifiers and their normalised sentences; * stands for a holder's name.
SENTENCES = {
    "apache-2.0-notice": ["licensed under the apache license version 2 0",
                          "licensed under the apache license version 2 0 the license",
                          "this project is licensed under the apache license version 2 0",
                          "the asf licenses this file to you under the apache license version 2 0 the license"],
    "apache-2.0-compliance": ["you may not use this file except in compliance with the license"],
    "apache-2.0-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0",
                        "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "mit-notice": ["released under the mit license", "licensed under the mit license",
                   "this project is licensed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction",
                  "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without limitation the "
                  "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                  "persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial "
                      "portions of the software",
                      "the above copyright notice and this permission notice including the next paragraph shall be included in all "
                      "copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind",
              "this software is provided as is without warranty of any kind",
              "the software is provided as is without warranty of any kind express or implied",
              "the software is provided as is without warranty of any kind express or implied including but not limited to the "
              "warranties of merchantability fitness for a particular purpose and noninfringement",
              "the software is provided as is without warranty of any kind express or implied including but not limited to the "
              "warranties of merchantability fitness for a particular purpose and non infringement"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that "
                  "the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the "
                   "following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                   "following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of * nor the names of its contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission",
                    "neither the name of * nor the names of any contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission"],
    "gpl-3-notice": ["this work is licensed under the gnu general public license version 3",
                     "licensed under the gnu general public license version 3"],
    "gpl-free": ["this program is free software"],
    "gpl-terms-3": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                    "the free software foundation either version 3 of the license or at your option any later version"],
    "cc-by-nc-4.0-notice": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0",
                            "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-4.0-notice": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0",
                         "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0-notice": ["licensed under cc0 1 0", "this work is in the public domain"],
    "all-rights": ["all rights reserved"],
    "copyright": ["copyright"],
}
#: Licences and the identifiers that make them, in order.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("Apache-2.0", ["apache-2.0-notice", "apache-2.0-compliance", "apache-2.0-copy"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms-3"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("Apache-2.0", ["apache-2.0-notice"]),
    ("MIT", ["mit-notice"]),
    ("GPL-3.0-only", ["gpl-3-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-notice"]),
    ("CC-BY-4.0", ["cc-by-4.0-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Proprietary", ["copyright", "all-rights"]),
    ("Proprietary", ["all-rights"]),
]
_KEYS = re.compile(r"licen[sc]|rights[\W_]+reserved|permission|redistribut|public[\W_]+domain|free[\W_]+software|copyright|"
                   r"without[\W_]+warranty")
_SENTENCE = re.compile(r"(?:[^\n.;:!?]|[.;:!?](?!\s|$))+")
_ITEM = re.compile(r"[\s#*/%|-]*\(?(?:[0-9]{1,2}|[A-Za-z]|[ivxIVX]{1,4})\)\s+")


def _tree() -> dict:
    """The known sentences word by word; the identifier stands under None."""
    root: dict = {}
    for name, group in SENTENCES.items():
        for sentence in group:
            node = root
            for word in sentence.split():
                node = node.setdefault(word, {})
            node[None] = name
    return root


_KNOWN = _tree()


def _words(sentence: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", sentence.lower()).split()


class _Piece(NamedTuple):
    number: int  # of its sentence
    start: int
    end: int
    words: list[str]
    joined: bool  # goes on with the sentence of the piece before
    dotted: bool  # or only a full stop is between, as after Inc.


def _pieces(text: str) -> list[_Piece]:
    out: list[_Piece] = []
    number, last, stops, blank = 0, 0, "", False
    for m in _SENTENCE.finditer(text):
        between = text[last:m.start()]
        last = m.end()
        stops += between
        blank = blank or between.count("\n") > 1
        words = _words(m.group())
        item = _ITEM.match(m.group()) if not out or "\n" in stops else None
        if not words:
            blank = blank or "\n" in between and text[m.end():m.end() + 1] in ("", "\n")
            continue
        start = m.start() + (item.end() if item else len(m.group()) - len(m.group().lstrip()))
        if item:
            words = _words(m.group()[item.end():])
        signs = set(stops) & set(".;:!?")
        apart = not out or item is not None or blank and words[:1] not in (["http"], ["https"])
        joined = not apart and not signs
        if out and (not joined or "\n" in stops and out[-1].end - text.rfind("\n", 0, out[-1].end) - 1 < WRAPPED):
            number += 1
        out.append(_Piece(number, start, m.end(), words, joined, not apart and signs <= {"."}))
        stops, blank = "", False
    return out


def _longest(pieces: list[_Piece], at: int) -> tuple[int, str] | None:
    """(last piece, identifier) of the longest known sentence that begins with a piece."""
    best, states = None, [(_KNOWN, 0)]  # with the words of a holder's name so far
    for i in range(at, len(pieces)):
        if i > at and not pieces[i].joined:
            states = [s for s in states if s[1]] if pieces[i].dotted else []
        for word in pieces[i].words:
            following = []
            for node, skipped in states:
                if word in node:
                    following.append((node[word], 0))
                if "*" in node:
                    following.append((node["*"], 1))
                if 0 < skipped < HOLDER:
                    following.append((node, skipped + 1))
            states = following
            if not states:
                return best
        best = next(((i, node[None]) for node, _ in states if None in node), best)
        if not states:
            break
    return best


def identify(text: str) -> list[tuple[int, int, int, str]]:
    """(number of the sentence, start, end, identifier) of the known sentences, in order."""
    out, pieces, at, inside = [], _pieces(text), 0, 0  # a known sentence counts once, however many lines it has
    while at < len(pieces):
        found = _longest(pieces, at)
        if not found and pieces[at].words[:1] == ["copyright"]:  # whatever holder and years follow
            found = at, "copyright"
        if found:
            out.append((pieces[at].number - inside, pieces[at].start, pieces[found[0]].end, found[1]))
            inside += pieces[found[0]].number - pieces[at].number
            at = found[0]
        at += 1
    return out


def match_rules(found: list[tuple[int, int, int, str]]) -> list[tuple[str, str, int, int]]:
    """(licence, rule, start, end) of all rules that fit, in the order of the text."""
    used, out = set(), []
    for licence, rule in sorted(RULES, key=lambda r: -len(r[1])):
        at = 0
        while at < len(found):
            picks: list[int] = []
            for i in range(at, len(found)):
                if i in used or found[i][3] != rule[len(picks)]:
                    continue
                if picks and found[i][0] - found[picks[-1]][0] > GAP + 1:
                    break
                picks.append(i)
                if len(picks) == len(rule):
                    break
            if not picks:
                break
            if len(picks) == len(rule):
                used.update(picks)
                out.append((licence, ">".join(rule), found[picks[0]][1], found[picks[-1]][2]))
            at = picks[0] + 1
    return sorted(out, key=lambda x: (x[2], x[3]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0), batch.column(1)):
            body = text.as_py() or ""
            if _KEYS.search(body.lower()):
                rows += [(doc.as_py(), *m) for m in match_rules(identify(body))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "license", "rule", "start", "end"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, rule, start, end) of every licence found; code points, end exclusive."""
    ship_package(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(
        _scan, "doc_id bigint, license string, rule string, start bigint, end bigint")
