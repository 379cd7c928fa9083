r"""Licence notices: lines of normal text against templates by the Dice coefficient of their word bigrams.

Normal text is lower-cased words of ASCII letters and digits. A line of a distinct bigrams and a template of b have a Dice
coefficient of 2 c / (a + b) for c in common, which cannot reach t unless t / (2 - t) <= a / b <= (2 - t) / t: only
templates within these bounds are compared. A line whose distinct bigrams outgrow the largest such bound fits no template,
so it is read only that far: a line of any length needs memory for a template's size. One pass without a shuffle; the
templates are a parameter of the caller and travel with the tasks.

A line's best template is reported (ties: first name). Null or empty texts and lines of fewer than two words have none.
Rows without an id and repeated rows are scanned each; an empty table gives no rows; extra columns are ignored.

`scan` and the query that SQL repeats know lines and one-sentence notices only. `passages` compares windows of words of
every size, over line breaks and within long lines, with notices, file headers and whole licence texts (`headers`, or a bank
of the caller). A window that fits a template of b bigrams holds at least t b / (2 - t) of them, so only documents that do
are compared, exactly. Of overlapping windows of one template the best is a passage; a passage inside one with more bigrams
in common is part of that one. There, words are runs of ASCII letters and digits before lower-casing.
"""

from __future__ import annotations

import bisect
import heapq
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, buffers, table, tiles, word_hashes, word_spans

LEAST = 0.8
WORD = re.compile("[a-z0-9]+")
#: Notices as licensors ask for them; fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: What licences ask for at the head of a file.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
#: ASCII lower case of a string; bytes of words in lower case, a space for all others.
ASCII = {c: c + 32 for c in range(65, 91)}
FOLD = np.array([LOWER[c] if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def _pairs(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _bigrams(line: str, most: int) -> set[str] | None:
    """Distinct word bigrams of a line; none if there are more than `most`."""
    met, last = set(), None
    for m in WORD.finditer(line.lower()):
        word = m.group()
        if last is not None:
            met.add(f"{last} {word}")
            if len(met) > most:
                return None
        last = word
    return met


def _reach(a: int, b: int) -> float:
    """Highest coefficient that sizes a and b allow, rounded as the coefficient itself is."""
    return 2.0 * min(a, b) / (a + b)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """`doc_id, line_no` (from 0), `license, common, n_line, n_template, dice` for each line that a template fits."""
    named = [(n, frozenset(_pairs(WORD.findall(t.lower())))) for n, t in sorted(templates)]
    bank = [(n, b) for n, b in named if b]
    most = longest = max((len(b) for _, b in bank), default=0)
    while longest and _reach(most + 1, longest) >= least:
        most += 1
    docs = docs.select("doc_id", "text")
    ids = docs.schema["doc_id"].dataType.simpleString()

    def best(line: str):
        met = _bigrams(line, most)
        top = None
        for name, b in bank if met else ():
            if _reach(len(met), len(b)) >= least:
                common = len(met & b)
                dice = 2.0 * common / (len(met) + len(b))
                if dice >= least and (top is None or dice > top[-1]):
                    top = name, common, len(met), len(b), dice
        return top

    def find(batches):
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        names = ["doc_id", "line_no", "license", "common", "n_line", "n_template", "dice"]
        for batch in batches:
            at, got = [], []
            for i, text in enumerate(batch.column("text")):
                for no, line in enumerate((text.as_py() or "").split("\n")):
                    if top := best(line):
                        at.append(i)
                        got.append((no, *top))
            rows = [pa.array([r[c] for r in got], kind) for c, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(at, pa.int32())), *rows], names=names)

    return docs.mapInArrow(find, f"doc_id {ids}, line_no int, license string, common int, n_line int, n_template int, dice double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 9))


def headers() -> list[tuple[str, str, str]]:
    """`license, form, text`: the notices, the headers licences ask for at the head of a file, and whole licence texts."""
    whole = [(p.stem, "body", p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))]
    return [(n, "notice", t) for n, t in TEMPLATES] + [(n, "header", t) for n, t in HEADERS] + whole


def _places(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word bigram of documents laid end to end, and its document."""
    b = FOLD[buf]
    starts, ends, first = word_spans(b, off)
    h = word_hashes(b, starts, ends)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    own = doc[1:] == doc[:-1]
    return (h[:-1] * np.uint64(0xD1B54A32D192ED03) + h[1:])[own], doc[:-1][own]


class Bank:
    """Bigrams of templates, and which documents may hold a window that fits one."""

    BITS = 22

    def __init__(self, templates: list[tuple[str, str, str]], least: float):
        pairs = [(n, f, t, frozenset(_pairs(WORD.findall(t.translate(ASCII))))) for n, f, t in sorted(templates)]
        pairs = [x for x in pairs if x[3]]
        self.least, self.rows = least, [(n, f, b) for n, f, _, b in pairs]
        self.need = np.array([next(c for c in range(len(b) + 1) if _reach(c, len(b)) >= least) for _, _, b in self.rows], np.int64)
        got = []
        for _, _, t, _ in pairs:
            raw = np.frombuffer(t.encode(), np.uint8)
            got.append(np.unique(_places(raw, np.array([0, len(raw)]))[0]))
        self.h = np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)
        self.has = np.stack([np.isin(self.h, g) for g in got], 1).astype(np.int32) if got else np.zeros((0, 0), np.int32)
        self.bit = np.zeros(1 << self.BITS, bool)
        self.bit[self._bit(self.h)] = True

    def _bit(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def candidates(self, buf: np.ndarray, off: np.ndarray):
        """`document, templates`: a window that fits a template of b bigrams has `need` of them, and so has its document."""
        if not self.rows:
            return
        for i, j in tiles(off):
            h, doc = _places(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            at = np.flatnonzero(self.bit[self._bit(h)])
            k = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
            real = self.h[k] == h[at]
            key = np.unique(doc[at[real]] * len(self.h) + k[real])
            if len(key):
                d = key // len(self.h)
                first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                fit = np.add.reduceat(self.has[key % len(self.h)], first) >= self.need
                for x in np.flatnonzero(fit.any(1)):
                    yield i + int(d[first[x]]), np.flatnonzero(fit[x]).tolist()

    def find(self, text: str, templates: list[int]) -> list[tuple]:
        """`line_no, start, end, license, form, common, n_window, n_template, dice` of the passages of one text."""
        low = text.translate(ASCII)
        spans = [m.span() for m in WORD.finditer(low)]
        words = [low[a:z] for a, z in spans]
        code: dict[tuple[str, str], int] = {}
        ids = np.array([code.setdefault(p, len(code)) for p in zip(words, words[1:])], np.int64)
        o = np.argsort(ids, kind="stable")
        last = np.full(len(ids), -1, np.int64)
        same = ids[o][1:] == ids[o][:-1]
        last[o[1:][same]] = o[:-1][same]
        got = []
        for t in templates:
            hit = np.array([f"{a} {z}" in self.rows[t][2] for a, z in code], bool)[ids]
            got += [(t, *w) for w in windows(last, hit, len(self.rows[t][2]), self.least)]
        # a passage inside one with more in common is part of that one
        got.sort(key=lambda w: (-w[3], -w[5], w[0], w[1]))
        out: list[tuple] = []
        for w in got:
            if not any(k[1] <= w[1] and w[2] <= k[2] for k in out):
                out.append(w)
        rows = []
        for t, i, e, c, a, dice in sorted(out, key=lambda w: (w[1], w[2], w[0])):
            name, form, b = self.rows[t]
            rows.append((text.count("\n", 0, spans[i][0]), spans[i][0], spans[e + 1][1], name, form, c, a, len(b), dice))
        return rows


def windows(last: np.ndarray, hit: np.ndarray, b: int, least: float) -> list[tuple[int, int, int, int, float]]:
    """`first, last, common, distinct, dice` of the windows of bigrams that fit a template of b, best first, none sharing a word.

    `last` is the place where a bigram occurred before (-1: nowhere), `hit` whether the template has it. Every window size
    is tried: the best window from a place on ends before the bigrams foreign to the template are too many for `least`.
    """
    spare = next(u for u in range(b + 2 + int(2 * b / least)) if 2.0 * b / (b + u + b) < least) - 1
    most = int((hit & (last < 0)).sum())

    def best(i: int, limit: int):
        size = 2 * b + spare
        while True:
            j = min(limit, i + size)
            new = last[i:j] < i
            a, c = np.cumsum(new), np.cumsum(new & hit[i:j])
            if j == limit or c[-1] == most or a[-1] - c[-1] > spare:
                break
            size *= 2
        dice = 2.0 * c / (a + b)
        k = int(dice.argmax())
        return (-float(dice[k]), i, i + k, int(c[k]), int(a[k])) if dice[k] >= least else None

    heap = [w for i in np.flatnonzero(hit).tolist() if (w := best(i, len(hit)))]
    heapq.heapify(heap)
    taken: list[tuple[int, int]] = []
    out = []
    while heap:
        d, i, e, c, a = heapq.heappop(heap)
        at = bisect.bisect(taken, (i, len(hit)))
        if at and i <= taken[at - 1][1] + 1:
            continue
        limit = taken[at][0] - 1 if at < len(taken) else len(hit)
        if e < limit:
            taken.insert(at, (i, e))
            out.append((i, e, c, a, -d))
        elif i < limit and (w := best(i, limit)):
            heapq.heappush(heap, w)
    return out


def passages(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """Each passage of words, over line breaks and within lines, that a template `license, form, text` fits.

    `doc_id, line_no` (of its first word), `start, end` (code points), `license, form, common, n_window, n_template, dice`.
    """
    bank = Bank(headers() if templates is None else templates, least)
    docs = docs.select("doc_id", "text")
    ids = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "line_no", "start", "end", "license", "form", "common", "n_window", "n_template", "dice"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def find(batches):
        for batch in batches:
            at, got = [], []
            texts = batch.column("text").fill_null("")
            for i, fit in bank.candidates(*buffers(texts)):
                rows = bank.find(texts[i].as_py(), fit)
                at += [i] * len(rows)
                got += rows
            cols = [pa.array([r[c] for r in got], kind) for c, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(at, pa.int32())), *cols], names=names)

    return docs.mapInArrow(find, f"doc_id {ids}, line_no int, start long, end long, license string, form string, common int, n_window int, n_template int, dice double")


def passages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 9))


_BANK = " UNION ALL ".join(f"SELECT '{n}' AS license, {_pairs(re.findall('[a-z0-9]+', t.lower()))} AS b" for n, t in TEMPLATES)
SQL = rf"""
WITH bank AS ({_BANK}),
lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
words AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM lines),
grams AS (SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1),
met AS (SELECT doc_id, line_no, license, len(list_intersect(g.b, k.b)) AS common, len(g.b) AS n_line, len(k.b) AS n_template FROM grams g, bank k)
SELECT doc_id, line_no::INTEGER AS line_no, license, common::INTEGER AS common, n_line::INTEGER AS n_line, n_template::INTEGER AS n_template, round(2.0::DOUBLE * common / (n_line + n_template), 9) AS dice
FROM met WHERE 2.0::DOUBLE * common / (n_line + n_template) >= {LEAST}
QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY common * 2.0 / (n_line + n_template) DESC, license) = 1"""
