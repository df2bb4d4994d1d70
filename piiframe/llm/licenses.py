"""License scans by template markup.

A template is wording with optional regions (``<<beginOptional>> ... <<endOptional>>``) and
replaceable ones (``<<var;name=...;max=N>>``, any 0 to N words).  It compiles to an automaton
over words; a text is accepted where all mandatory wording stands exactly, whatever stands in
the optional and replaceable regions.  Case and all that is no word do not count.  All
templates' automata run together as one, whose steps are kept as they are first taken.

Defined results: a null or empty text has no words, no places (0 and nulls) and no labels
(empty string); repeated rows get equal results; a null doc_id is kept; an empty table gives no
rows.  Only doc_id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_bytes

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licence wording, by SPDX identifier; of long licences the standard notice.
# Wording that several licences share comes first.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;name=holder;max=12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the software) to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so"
_MIT_KEEP = "subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the software"
_ISC_GRANT = "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "the software is provided as is and <<var;name=author;max=8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;name=author;max=8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_BSD_1_2 = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
_BSD_NAMES = "neither the name of <<var;name=organization;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "this software is provided by <<var;name=holder;max=10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;name=holder;max=10>> be liable for any direct indirect incidental special exemplary or consequential damages (including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption) however caused and on any theory of liability whether in contract strict liability or tort (including negligence or otherwise) arising in any way out of the use of this software even if advised of the possibility of such damage"
_GNU_NOTICE = "you can redistribute it and/or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or (at your option) any later version"
_CC = "licensed under <<beginOptional>>a<<endOptional>> {short} 4.0"
_CC_LONG = "licensed under a creative commons attribution <<beginOptional>>-<<endOptional>> {long} 4.0 international license"
TEMPLATES = {
    "0BSD": [f"{_ISC_GRANT} {_ISC_AS_IS}"],
    "AGPL-3.0": [_GNU_NOTICE.format(name="affero general public license", version="3"), "gnu affero general public license version 3"],
    "Apache-2.0": [
        "licensed under the apache license <<beginOptional>>version<<endOptional>> 2.0",
        "licensed under the apache license version 2.0 (the license) you may not use this file except in compliance with the license you may obtain a copy of the license at <<var;name=address;max=10>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "Artistic-2.0": ["the artistic license 2.0"],
    "BSD-2-Clause": [f"{_BSD_1_2} {_BSD_AS_IS}"],
    "BSD-3-Clause": [f"{_BSD_1_2} <<beginOptional>>3<<endOptional>> {_BSD_NAMES} {_BSD_AS_IS}"],
    "BSD-4-Clause": [f"{_BSD_1_2} <<beginOptional>>3<<endOptional>> all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <<var;name=organization;max=16>> <<beginOptional>>4<<endOptional>> {_BSD_NAMES} {_BSD_AS_IS}"],
    "BSL-1.0": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the software) to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non-infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "distributed under the boost software license version 1.0",
    ],
    "CC-BY-4.0": [_CC.format(short="cc by"), "licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC-4.0": [_CC.format(short="cc by-nc"), _CC_LONG.format(long="noncommercial")],
    "CC-BY-NC-ND-4.0": [_CC.format(short="cc by-nc-nd"), _CC_LONG.format(long="noncommercial-noderivatives")],
    "CC-BY-NC-SA-4.0": [_CC.format(short="cc by-nc-sa"), _CC_LONG.format(long="noncommercial-sharealike")],
    "CC-BY-ND-4.0": [_CC.format(short="cc by-nd"), _CC_LONG.format(long="noderivatives")],
    "CC-BY-SA-4.0": [_CC.format(short="cc by-sa"), _CC_LONG.format(long="sharealike")],
    "CC0-1.0": ["cc0 1.0 universal", "to the extent possible under law <<var;name=who;max=12>> has waived all copyright and related or neighboring rights to <<var;name=work;max=12>> this work"],
    "CDDL-1.0": ["common development and distribution license <<beginOptional>>(cddl)<<endOptional>> version 1.0"],
    "EPL-1.0": ["terms of the eclipse public license <<beginOptional>>v<<endOptional>> 1.0", "eclipse public license v 1.0"],
    "EPL-2.0": ["terms of the eclipse public license <<beginOptional>>v<<endOptional>> 2.0", "eclipse public license v 2.0"],
    "GPL-2.0": ["gnu general public license version 2", _GNU_NOTICE.format(name="general public license", version="2"), "gnu general public license as published by the free software foundation either version 2 of the license"],
    "GPL-3.0": [
        "<<beginOptional>>this <<var;name=what;max=3>> is<<endOptional>> licensed under the gnu general public license <<beginOptional>>version<<endOptional>> 3",
        _GNU_NOTICE.format(name="general public license", version="3"),
        "gnu general public license as published by the free software foundation either version 3 of the license",
    ],
    "ISC": [f"{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies {_ISC_AS_IS}"],
    "LGPL-2.1": [_GNU_NOTICE.format(name="lesser general public license", version="2.1"), "gnu lesser general public license version 2.1"],
    "LGPL-3.0": [_GNU_NOTICE.format(name="lesser general public license", version="3"), "gnu lesser general public license version 3"],
    "MIT": [
        "<<beginOptional>>is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> mit license",
        "<<beginOptional>>is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> mit license",
        f"{_MIT_GRANT} {_MIT_KEEP} {_AS_IS}",
    ],
    "MIT-0": [f"{_MIT_GRANT} {_AS_IS}"],
    "MPL-2.0": [
        "mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license <<var;name=v;max=2>> 2.0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ],
    "MS-PL": ["microsoft public license (ms-pl)"],
    "NTP": [
        "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in supporting documentation and that the name <<var;name=holder;max=12>> not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission <<var;name=holder;max=12>> makes no representations about the suitability <<beginOptional>>of<<endOptional>> this software for any purpose it is provided as is without express or implied warranty",
    ],
    "OFL-1.1": ["sil open font license version 1.1", "this font software is licensed under the sil open font license"],
    "PostgreSQL": [
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies in no event shall <<var;name=holder;max=10>> be liable to any party for direct indirect special incidental or consequential damages including lost profits arising out of the use of this software and its documentation even if <<var;name=holder;max=10>> has been advised of the possibility of such damage <<var;name=holder;max=10>> specifically disclaims any warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose the software provided hereunder is on an as is basis and <<var;name=holder;max=10>> has no obligations to provide maintenance support updates enhancements or modifications",
    ],
    "Python-2.0": ["python software foundation license version 2"],
    "Unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _AS_IS,
    ],
    "WTFPL": ["do what the fuck you want to public license terms and conditions for copying distribution and modification <<beginOptional>>0<<endOptional>> you just do what the fuck you want to"],
    "X11": [f"{_MIT_GRANT} {_MIT_KEEP} {_AS_IS} except as contained in this notice the name of <<var;name=holder;max=10>> shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from"],
    "Zlib": [
        "this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<beginOptional>>1<<endOptional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<beginOptional>>2<<endOptional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<beginOptional>>3<<endOptional>> this notice may not be removed or altered from any source distribution",
    ],
}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and all that is not ASCII, with A-Z lower-cased."""
    return text.translate(_FOLD).split()


_MARK = re.compile(r"<<(beginOptional|endOptional|var)([^>]*)>>")


class Automaton:
    """The templates of all labels as one automaton over words, searched anywhere in a text."""

    def __init__(self, templates: dict[str, list[str]]):
        self.free: list[list[int]] = [[]]  # steps that read nothing
        self.read: list[dict[bytes | None, list[int]]] = [{}]  # by word; None reads any
        self.accepts: dict[int, str] = {}
        for label, markups in sorted(templates.items()):
            for markup in markups:
                self.accepts[self._compile(markup, 0)] = label
        self.known = frozenset(w for step in self.read for w in step if w is not None)
        self.start = self._closure({0})
        self.steps: dict[tuple[frozenset, bytes | None], frozenset] = {}
        self.labels: dict[frozenset, frozenset] = {}

    def _state(self) -> int:
        self.free.append([])
        self.read.append({})
        return len(self.free) - 1

    def _word(self, at: int, word: bytes | None) -> int:
        to = self._state()
        self.read[at].setdefault(word, []).append(to)
        return to

    def _compile(self, markup: str, at: int) -> int:
        """The state after the markup; a run of states per template, with shortcuts."""
        end = 0
        opened: list[int] = []
        for mark in [*_MARK.finditer(markup), None]:
            for word in words(markup[end : mark.start() if mark else None].encode()):
                at = self._word(at, word)
            if mark is None:
                break
            end = mark.end()
            if mark[1] == "beginOptional":
                opened.append(at)
            elif mark[1] == "endOptional":
                to = self._state()
                self.free[at].append(to)
                self.free[opened.pop()].append(to)
                at = to
            else:
                most = int(re.search(r"max=(\d+)", mark[2])[1])
                to = self._state()
                self.free[at].append(to)
                for _ in range(most):
                    at = self._word(at, None)
                    self.free[at].append(to)
                at = to
        return at

    def _closure(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word if word in self.known else None)
        found = self.steps.get(key)
        if found is None:
            to = {t for s in states for w in {word, None} for t in self.read[s].get(w, ())}
            found = self.steps[key] = self._closure(to) | self.start
            self.labels[found] = frozenset(self.accepts[s] for s in found if s in self.accepts)
        return found

    def search(self, text: list[bytes]) -> set[str]:
        """Labels of the templates that stand somewhere in the text."""
        found: set[str] = set()
        states, known, steps = self.start, self.known, self.steps
        for word in text:
            to = steps.get((states, word if word in known else None))
            if to is None:
                to = self.step(states, word)
            states = to
            if self.labels[to]:
                found |= self.labels[to]
        return found


def mandatory(markup: str) -> list[bytes]:
    """The words of a template that stand in no optional region."""
    out, depth, end = [], 0, 0
    for mark in [*_MARK.finditer(markup), None]:
        if not depth:
            out += words(markup[end : mark.start() if mark else None].encode())
        if mark:
            depth += {"beginOptional": 1, "endOptional": -1}.get(mark[1], 0)
            end = mark.end()
    return out


def gate(templates: dict[str, list[str]]) -> list[bytes]:
    """Few words of which every template must hold one, so that a text without them needs no
    search: again and again the one that most of the templates left hold, the longest of those.
    Empty (and no gate) where a template has no mandatory word."""
    left = [set(mandatory(m)) for markups in templates.values() for m in markups]
    out: list[bytes] = []
    while left:
        count: dict[bytes, int] = {}
        for own in left:
            for w in own:
                # a word that nearly every text has is no gate
                count[w] = count.get(w, 0) + (1 if len(w) > 4 else 0)
        best = max(count, key=lambda w: (count[w], len(w), w), default=None)
        if best is None or not all(left):
            return []
        if not count[best]:  # short words only
            best = max(left[0], key=lambda w: (len(w), w))
        out.append(best)
        left = [own for own in left if best not in own]
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES):
        self.phrases = [(b" " + b" ".join(words(p.encode())) + b" ", label) for p, label in phrases.items()]
        self.automaton = Automaton(templates)
        self.gate = [b" " + w + b" " for w in gate(templates)]

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        own = words(text)
        line = b" " + b" ".join(own) + b" "
        places: list[int] = []
        base: set[str] = set()
        for phrase, label in self.phrases:
            at = line.find(phrase)
            before, from_ = 0, 0
            while at >= 0:
                before += line.count(b" ", from_, at)
                from_ = at
                places.append(before)
                base.add(label)
                at = line.find(phrase, at + 1)
        found = self.automaton.search(own) if not self.gate or any(g in line for g in self.gate) else set()
        score = 1.0 if found else 0.5 if base else 0.0
        return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score


_SCANNER: list[Scanner] = []


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the columns of Scanner.scan; score is 1 where a template is accepted, a half
    where only a phrase stands."""
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in slices(batches, 1):
            rows = [(doc, *_SCANNER[0].scan(data)) for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(of, schema)
