"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Each text is searched for its own notice: windows of one to three lines are compared
with the templates by the cosine of TF-IDF vectors, windows as long as a header
block with that block, and the whole text with the full texts in ``licenses/``.
Document frequencies of the templates' terms are counted over all texts; terms
outside the templates weigh as much as a term seen in no text. A text that as a whole is near a notice or a full text is a
licence file and speaks for its directory. Texts without a notice inherit from the nearest
directory above them that has such a file, by joins of directory paths.

Whole texts are always compared, windows only around anchor terms: without one of a template's heaviest
terms a window cannot reach the threshold (Cauchy's inequality on what is left), so
this skips nothing.

Defined results
    null text: as the empty text, no notice of its own. Null path: no directory, no
    inheritance. Ties between templates go to the first name, between files of one
    directory to the higher cosine, then the first path. Repeated rows each get a
    result. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm.shared import materialise, spread_join

# Usual notices of common licences.
NOTICES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Licensed under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def _gnu(what: str, kind: str, version: str) -> str:
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details. "
        f"You should have received a copy of the GNU {kind} Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )


def _old(what: str, kind: str, version: str) -> list[str]:
    """With the link, and with the post address of older files."""
    text = _gnu(what, kind, version)
    return [text, text.replace("If not, see <https://www.gnu.org/licenses/>.", "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")]


# The blocks that licences ask for at the head of a source file.
HEADERS = {
    "AGPL-3.0": [_gnu("program", "Affero General", "3")],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ],
    "GPL-1.0": _old("program", "General", "1"),
    "GPL-2.0": _old("program", "General", "2"),
    "GPL-3.0": [_gnu("program", "General", "3")],
    "LGPL-2.0": _old("library", "Library General", "2"),
    "LGPL-2.1": _old("library", "Lesser General", "2.1"),
    "LGPL-3.0": [_gnu(what, "Lesser General", "3") for what in ("program", "library")],
    "MPL-1.1": [
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, "
        "either express or implied. See the License for the specific language governing rights and limitations under the License."
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
THRESHOLD, FILE_THRESHOLD = 0.75, 0.5
#: A whole licence has so many common words that any long text is half like it.
FULL_THRESHOLD = 0.9
WINDOW_LINES = 3

_TERM = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def templates(notices: dict[str, list[str]] = NOTICES) -> list[tuple[str, Counter]]:
    """Names and term counts, with an SPDX tag for each name."""
    return [(name, Counter(terms(t))) for name in sorted(notices) for t in [*notices[name], f"SPDX-License-Identifier: {name}"]]


def blocks(headers: dict[str, list[str]] = HEADERS) -> list[tuple[str, Counter]]:
    """Names and term counts of the header blocks."""
    return [(name, Counter(terms(t))) for name in sorted(headers) for t in headers[name]]


@cache
def full_texts() -> tuple[tuple[str, Counter], ...]:
    """Names and term counts of the licences' full texts."""
    return tuple((f.stem, Counter(terms(f.read_text("utf-8")))) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))


@dataclass(frozen=True)
class Matcher:
    """Templates as unit TF-IDF vectors, and the terms without which nothing matches."""

    idf: dict[str, float]
    rare: float
    vectors: list[tuple[str, dict[str, float]]]
    anchors: frozenset[str]
    #: Header blocks with their lengths in terms, their anchors, and full texts.
    headers: tuple[tuple[str, dict[str, float], int], ...] = ()
    header_anchors: frozenset[str] = frozenset()
    full: tuple[str, ...] = ()
    #: By term, its weight in each full text.
    full_weights: dict[str, list[tuple[int, float]]] = field(default_factory=dict)

    @classmethod
    def fitted(cls, counts: dict[str, int], n: int, notices: dict[str, list[str]] = NOTICES, threshold: float = FILE_THRESHOLD) -> Matcher:
        """From the number of texts ``n`` and those that hold each template term."""
        weigh = lambda df: math.log((n + 1) / (df + 1)) + 1
        rare = weigh(0)
        idf = {t: weigh(counts.get(t, 0)) for _, c in [*templates(notices), *blocks(), *full_texts()] for t in c}

        def unit(c: Counter) -> dict[str, float]:
            v = {t: k * idf[t] for t, k in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            return {t: x / norm for t, x in v.items()}

        def needed(v: dict[str, float], least: float, order=lambda p: (p[1], p[0])) -> set[str]:
            left, out = 0.0, set()
            for t, x in sorted(v.items(), key=order):
                left += x * x
                if left >= least * least * 0.999:
                    out.add(t)
            return out

        vectors = [(name, unit(c)) for name, c in templates(notices)]
        headers = tuple((name, unit(c), c.total()) for name, c in blocks())
        full = [unit(c) for _, c in full_texts()]
        weights = {t: [(i, v[t]) for i, v in enumerate(full) if t in v] for t in set().union(*full)}
        anchors = frozenset(set().union(*(needed(v, threshold) for _, v in vectors)))
        header_anchors = frozenset(set().union(*(needed(v, THRESHOLD, lambda p: (idf[p[0]], p[0])) for _, v, _ in headers)))
        return cls(idf, rare, vectors, anchors, headers, header_anchors, tuple(name for name, _ in full_texts()), weights)

    def norm(self, counts: Counter) -> float:
        return math.sqrt(sum((k * self.idf.get(t, self.rare)) ** 2 for t, k in counts.items()))

    def whole(self, counts: Counter) -> tuple[str | None, float]:
        """The nearest full text and its cosine, or zero if that is below the threshold for certain."""
        known = self.full_weights.keys() & counts.keys()
        norm = self.norm(counts)
        # The part of the text's vector inside the templates' terms bounds every cosine.
        if not known or sum((counts[t] * self.idf[t]) ** 2 for t in known) < (FULL_THRESHOLD * norm) ** 2 * 0.999:
            return None, 0.0
        scores = [0.0] * len(self.full)
        for t in known:
            x = counts[t] * self.idf[t]
            for i, w in self.full_weights[t]:
                scores[i] += x * w
        score, i = max((x, -i) for i, x in enumerate(scores))
        return self.full[-i], score / norm

    def header(self, lines: list[Counter]) -> tuple[str | None, float]:
        """The nearest header block and its cosine, over windows as long as each block."""
        marked = [i for i, c in enumerate(lines) if not self.header_anchors.isdisjoint(c)]
        ends = [0, *accumulate(c.total() for c in lines)]
        spans: dict[tuple[int, int], set[int]] = defaultdict(set)
        for length in {n for _, _, n in self.headers}:
            starts = {a for i in marked for a in range(bisect_left(ends, ends[i] - length + 1, 0, i), i + 1)}
            for a in starts:
                b = bisect_left(ends, ends[a] + length, a + 1)
                spans[a, min(b, len(lines))].add(length)
                spans[a, max(a + 1, min(b - 1, len(lines)))].add(length)
        found = (None, 0.0)
        for a, b in sorted(spans):
            counts = sum(lines[a:b], Counter())
            norm = self.norm(counts)
            for name, v, n in self.headers if norm else ():
                score = sum(k * self.idf[t] * v[t] for t, k in counts.items() if t in v) / norm if n in spans[a, b] else 0.0
                if score > found[1] + 1e-12:
                    found = name, score
        return found

    def best(self, counts: Counter) -> tuple[str | None, float]:
        """The nearest template and its cosine."""
        norm = self.norm(counts)
        if not norm:
            return None, 0.0
        mine = {t: k * self.idf[t] / norm for t, k in counts.items() if t in self.idf}
        scores = [(sum(x * mine.get(t, 0.0) for t, x in v.items()), name) for name, v in self.vectors]
        score, name = max(scores, key=lambda s: (s[0], [-ord(c) for c in s[1]]))
        return name, score

    def scan(self, text: str) -> tuple[str | None, float, bool]:
        """The notice of a text, its cosine, and whether the text is a licence file."""
        every = Counter(terms(text))
        full = self.whole(every)
        if full[1] >= FULL_THRESHOLD:
            return *full, True
        if self.anchors.isdisjoint(every) and self.header_anchors.isdisjoint(every):
            return None, 0.0, False
        lines = [Counter(terms(line)) for line in text.split("\n")]
        marked = [i for i, c in enumerate(lines) if not self.anchors.isdisjoint(c)]
        spans = {(a, min(len(lines), a + k)) for i in marked for k in range(1, WINDOW_LINES + 1) for a in range(max(0, i - k + 1), i + 1)}
        found = (None, 0.0)
        for a, b in sorted(spans):
            name, score = self.best(sum(lines[a:b], Counter()))
            if score > found[1] + 1e-12:
                found = name, score
        name, score = self.best(every) if len(lines) > 1 else found
        whole = score >= FILE_THRESHOLD
        block = self.header(lines)
        if block[1] >= THRESHOLD and block[1] > found[1]:
            return *block, whole
        if found[1] >= THRESHOLD:
            return found[0], found[1], whole
        return (name, score, True) if whole else (None, found[1], False)


def fit(texts: DataFrame, text_column: str = "text") -> Matcher:
    """A matcher with document frequencies over all rows; only the templates' terms are counted."""
    known = frozenset(t for _, c in [*templates(), *blocks(), *full_texts()] for t in c)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen[""] += 1
                seen.update(known.intersection(terms(text.as_py() or "")))
        yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, schema=pa.schema([("term", pa.string()), ("n", pa.int64())]))

    sums = texts.select(text_column).mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in sums.collect()}  # as many rows as the templates have terms
    return Matcher.fitted(counts, counts.get("", 0))


def notices(files: DataFrame, matcher: Matcher) -> DataFrame:
    """``file_id, path, license, similarity, license_file`` for ``files(file_id, path, text)``."""
    schema = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("license", pa.string()), ("similarity", pa.float64()), ("license_file", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [matcher.scan(t.as_py() or "") for t in batch.column(2)]
            names, scores, whole = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(whole, pa.bool_())], schema=schema)

    return files.select(F.col("file_id").cast("long"), "path", "text").mapInArrow(run, "file_id bigint, path string, license string, similarity double, license_file boolean")


def directory(path: Column) -> Column:
    """Everything before the last slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(found: DataFrame) -> DataFrame:
    """Adds ``license`` of the nearest directory, ``origin`` (own, inherited or null) and ``origin_path``.

    ``found`` is read several times. A directory with very many files is no hot task.
    """
    found = found.withColumn("dir", directory(F.col("path")))
    best = F.max_by(F.struct("license", F.col("path").alias("from")), F.struct("similarity", F.transform(F.split("path", ""), lambda c: -F.ascii(c)).alias("order")))
    holders = found.where("license_file and path is not null").groupBy("dir").agg(best.alias("best")).select(F.col("dir").alias("holder"), "best")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    sizes = found.where("path is not null").groupBy("dir").agg(F.count("*").alias("files"))
    dirs = sizes.select("dir", "files", F.posexplode(above).alias("depth", "up"))
    # The upper directories repeat below each of their own; only those with a holder are sent or shuffled on.
    holders = holders.join(dirs.groupBy(F.col("up").alias("holder")).agg(F.count("*").alias("below")), "holder")
    near = spread_join(dirs.withColumnRenamed("up", "holder"), "holder", holders, "below", max(1, sizes.count()))
    nearest = near.groupBy("dir").agg(F.max_by("best", "depth").alias("near"), F.first("files").alias("files"))
    placed = spread_join(found.where("path is not null"), "dir", nearest, "files", found.count(), "left")
    out = placed.unionByName(found.where("path is null").withColumn("near", F.lit(None).cast(nearest.schema["near"].dataType)))
    own = F.col("license").isNotNull()
    return out.select(
        "file_id", "path", F.coalesce("license", "near.license").alias("license"), "similarity", "license_file",
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").alias("origin"), F.when(own, F.col("path")).otherwise(F.col("near.from")).alias("origin_path"),
    )


def scan(files: DataFrame) -> DataFrame:
    """Licences of ``files(file_id, path, text)``, own or inherited."""
    return inherit(materialise(notices(files, fit(files)), "license-notices"))


def document_path(docs: DataFrame) -> Column:
    """A path for rows of ``documents``: source, language, hundred, id."""
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.expr("doc_id div 100").cast("string"), F.col("doc_id").cast("string"))
