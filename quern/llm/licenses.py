"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then directory inheritance.

A file's headers are its lines, wherever they stand, and all runs of ``LINES`` lines, as notices are wrapped; a licence file (named LICENSE,
LICENCE, COPYING or UNLICENSE, with or without an ending) is compared as a whole, too. Templates are short wordings of headers and
the whole texts of common licences, these kept as counts of their words in ``license_words.json``. Words are runs of ASCII letters, digits and
characters of other scripts; a word of the templates weighs by its count times its inverse document frequency over all files, any other word as
the templates' mean word does. The best template at a cosine of ``THRESHOLD`` or more is the file's own licence: for a licence file that
of its whole text if there is one, else of its headers; a reservation of all rights ("Proprietary") counts if nothing else is found. Files without
a licence take that of the nearest ancestor directory that holds a licence file with one: directories and the ancestors of paths are joined.

Products are sparse: only words that a run shares with templates are multiplied, by the postings of each word. The cosine to any template is at most the
share of a run's norm that lies in template words, and for a run of L lines with known and unknown weights K and U of the lines at most
sqrt(L K / (L K + U)), so runs under the threshold by that bound are passed over without loss.

Defined cases: a null or blank text has no licence of its own but may inherit; a null path can't inherit and is reported with
its own licence only; of several best templates the first by name holds; of several licence files in one directory the best score, then the least path, then the least id;
repeated rows are reported each; a file without licence is not reported; an empty table gives no rows; columns besides the named are ignored;
texts are read whole.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vec
from quern.llm.frames import cols
from quern.session import settle

THRESHOLD = 0.6
#: Lines of the runs that are compared.
LINES = (1, 2, 4)
RESERVED = "Proprietary"
LICENCE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying)[^/]*$"
#: (licence, wording) as commonly written in headers.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or"),
    ("LGPL-2.1", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or"),
    ("ISC", "Licensed under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_NL = np.zeros(256, bool)
_NL[10] = True


#: licence: the words of its whole text and their counts.
WHOLE: dict[str, dict[str, int]] = {n: {w: int(c) for w, c in (x.split(":") for x in t.split())} for n, t in json.loads(Path(__file__).with_name("license_words.json").read_text(encoding="utf-8")).items()}


def word_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, line, hash of each word, row of each line), slice by slice; lines count through the slice, empty ones too."""
    for i, _, buf, off in vec.slices(texts):
        buf = vec.LOWER[buf]
        start, end, row = vec.words(buf, off, _WORD)
        if len(start):
            lines = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(_NL[buf], out=lines[1:])
            per = np.diff(lines[off]) + 1
            yield i, row, lines[start] + row, vec.word_hashes(buf, start, end), np.repeat(np.arange(len(off) - 1), per)


class Templates:
    """Templates in the order of (name, counts): postings of each word, sparse."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, whole: dict[str, dict[str, int]] = WHOLE) -> None:
        bags = [(n, _bag(t)) for n, t in sorted(templates)] + sorted(whole.items())
        self.name = [n for n, _ in bags]
        own = np.repeat(np.arange(len(bags)), [len(b) for _, b in bags])
        tf = np.array([c for _, b in bags for c in b.values()], float)
        h = np.concatenate([x[3] for x in word_sets(pa.array([" ".join(b) for _, b in bags], pa.large_string()))])
        self.vocab, term = np.unique(h, return_inverse=True)
        order = np.lexsort((own, term))
        self.own, self.term, self.tf = own[order], term[order], tf[order]
        self.first = np.searchsorted(self.term, np.arange(len(self.vocab) + 1))

    def terms(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at, -1)

    def weigh(self, df: np.ndarray, files: int) -> None:
        self.idf = np.log((1 + files) / (1 + df)) + 1
        w = self.tf * self.idf[self.term]
        self.w = w / np.sqrt(np.bincount(self.own, w * w))[self.own]
        self.other = float(self.idf.mean())

    def counts(self, unit: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(unit, term or -1, count, weight) of the distinct words of each unit, by unit."""
        order = np.lexsort((h, unit))
        unit, h = unit[order], h[order]
        at = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (h[1:] != h[:-1])])
        n = np.diff(np.r_[at, len(h)])
        term = self.terms(h[at])
        return unit[at], term, n, np.where(term >= 0, self.idf[term], self.other)

    def best(self, unit: np.ndarray, h: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, template, cosine) of each unit of words and template that reach the threshold."""
        none = np.zeros(0, np.int64)
        if not len(unit):
            return none, none, none
        unit, term, n, w = self.counts(unit, h)
        w = w * n
        units, group = np.unique(unit, return_inverse=True)
        norm = np.bincount(group, w * w)
        known = term >= 0
        maybe = np.bincount(group[known], w[known] ** 2, len(units)) >= threshold * threshold * norm * (1 - 1e-9)
        m = known & maybe[group]
        group, term, w = group[m], term[m], w[m]
        n = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else none
        number = np.cumsum(maybe) - 1
        key = np.repeat(number[group], n) * len(self.name) + self.own[at]
        cos = np.bincount(key, np.repeat(w, n) * self.w[at], int(maybe.sum()) * len(self.name)).reshape(-1, len(self.name)) / np.sqrt(norm[maybe])[:, None]
        u, k = np.nonzero(cos >= threshold)
        return units[maybe][u], k, cos[u, k]

    def runs(self, line: np.ndarray, h: np.ndarray, row_of: np.ndarray, lines: tuple[int, ...], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first line, words) of the runs of lines of one row that may reach the threshold, for each length."""
        own, term, n, w = self.counts(line, h)
        square = (w * n) ** 2
        known, other = (np.r_[0, np.cumsum(np.bincount(own[m], square[m], len(row_of)))] for m in (term >= 0, term < 0))
        first = np.searchsorted(line, np.arange(len(row_of) + 1))
        for size in lines:
            s = np.arange(len(row_of) - size + 1)
            k, u = (x[s + size] - x[s] for x in (known, other))
            s = s[(row_of[s] == row_of[s + size - 1]) & (k > 0) & (size * k * (1 + 1e-9) >= threshold * threshold * (size * k + np.maximum(u, 0)))]
            per = first[s + size] - first[s]
            at = np.repeat(first[s] - np.r_[0, np.cumsum(per)[:-1]], per) + np.arange(per.sum()) if len(s) else s
            yield np.repeat(s, per), h[at]


def _bag(text: str) -> dict[str, int]:
    raw = text.encode()
    kind = _WORD[np.frombuffer(raw, np.uint8)]
    return dict(Counter("".join(c.lower() if c.isascii() else c for c in bytes(b if k else 32 for b, k in zip(raw, kind)).decode()).split()))


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, lines: tuple[int, ...] = LINES, templates: list[tuple[str, str]] = TEMPLATES, whole: dict[str, dict[str, int]] = WHOLE) -> DataFrame:
    """(doc_id, path, license, score, origin, origin_path): origin is "header", "file" or "inherited"."""
    spark = files.sparkSession
    own = cols(files, id=id_col, path=path_col, text=text_col).withColumn("whole", F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)))
    t = Templates(templates, whole)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(t.vocab), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, row, _, h, _ in word_sets(b.column("text")):
                term = t.terms(h)
                k = np.unique(row[term >= 0] * len(t.vocab) + term[term >= 0])
                df += np.bincount(k % len(t.vocab), minlength=len(t.vocab))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], ["term", "df"])

    # a row for each template word, and the number of files
    got = own.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(len(t.vocab))
    for r in got:
        if r.term >= 0:
            df[r.term] = r.df
    t.weigh(df, sum(r.df for r in got if r.term < 0))
    sent = spark.sparkContext.broadcast(t)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            best: dict[int, tuple] = {}
            is_file = np.asarray(b.column("whole"))

            def take(rows: np.ndarray, ks: np.ndarray, scores: np.ndarray, whole: bool) -> None:
                for r, k, s in zip(rows.tolist(), ks.tolist(), scores.tolist()):
                    new = (not whole, m.name[k] == RESERVED, -round(s, 9), m.name[k])
                    if r not in best or new < best[r]:
                        best[r] = new

            for i, row, line, h, row_of in word_sets(b.column("text")):
                for first, words in m.runs(line, h, row_of, lines, threshold):
                    u, k, s = m.best(first, words, threshold)
                    take(i + row_of[u], k, s, False)
                w = is_file[i + row]
                u, k, s = m.best(row[w], h[w], threshold)
                take(i + u, k, s, True)
            # every file goes on, for those without a licence may inherit one
            name, score, origin = ([None] * b.num_rows for _ in range(3))
            for r, v in best.items():
                name[r], score[r], origin[r] = v[3], -v[2], "file" if is_file[r] else "header"
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("path"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(origin, pa.string())], ["doc_id", "path", "license", "score", "origin"])

    found = settle(own.select(F.col("id").cast("long").alias("id"), "path", "text", "whole").mapInArrow(match, "doc_id long, path string, license string, score double, origin string"), "licenses")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    held = found.where("origin = 'file'").groupBy(folder.alias("dir")).agg(F.min_by(F.struct("license", "score", F.col("path").alias("origin_path")), F.struct(-F.col("score"), "path", "doc_id", "license")).alias("best"))
    parts = F.split("own_dir", "/")
    above = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    bare = found.where("license IS NULL AND path IS NOT NULL").select("doc_id", "path")
    # one row for each distinct folder, not for each file
    chain = bare.select(folder.alias("own_dir")).distinct().select("own_dir", F.explode(above).alias("dir"))
    near = chain.join(held, "dir").groupBy("own_dir").agg(F.max_by("best", F.length("dir")).alias("best"))
    heirs = bare.withColumn("own_dir", folder).join(near, "own_dir").select("doc_id", "path", "best.license", "best.score", F.lit("inherited").alias("origin"), "best.origin_path")
    return found.where("license IS NOT NULL").withColumn("origin_path", F.col("path")).unionByName(heirs)


def as_files(docs: DataFrame) -> DataFrame:
    """The documents as a file tree: source/language/hundred/name; a text under 200 characters that speaks of a
    licence is its folder's licence file."""
    short = (F.length("text") < 200) & F.lower("text").like("%licen%")
    name = F.when(short, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.expr("doc_id div 100"), name).alias("path"), "text")


def _sql() -> str:
    bags = [(n, _bag(t)) for n, t in sorted(TEMPLATES)] + sorted(WHOLE.items())
    quoted = ", ".join(f"({k}, '{n}', '{' '.join(f'{w}:{c}' for w, c in b.items())}')" for k, (n, b) in enumerate(bags))
    fold = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda x: f"regexp_extract_all({fold(x)}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')".replace("{{", "{").replace("}}", "}")
    sizes = ", ".join(f"({n})" for n in LINES)
    return f"""
WITH RECURSIVE t1 AS (SELECT tid, name, unnest(string_split(bag, ' ')) AS x FROM (VALUES {quoted}) v(tid, name, bag)),
t2 AS (SELECT tid, name, split_part(x, ':', 1) AS w, split_part(x, ':', 2)::INT AS tf FROM t1),
files AS (SELECT doc_id, text, concat_ws('/', source, lang, doc_id // 100,
          CASE WHEN length(text) < 200 AND lower(text) LIKE '%licen%' THEN 'LICENSE-' || doc_id ELSE 'doc-' || doc_id || '.txt' END) AS path FROM documents),
cut AS (SELECT doc_id, path, string_split(text, chr(10)) AS ls FROM files),
ls AS (SELECT doc_id, path, array_to_string(ls[n : n + size - 1], ' ') AS line, n, size
       FROM (SELECT doc_id, path, ls, size, unnest(range(1, len(ls) - size + 2)) AS n FROM cut, (VALUES {sizes}) z(size) WHERE len(ls) >= size)
       UNION ALL SELECT doc_id, path, text, 0, 0 FROM files WHERE path LIKE '%/LICENSE-%'),
ws AS (SELECT doc_id, path, n, size, unnest({words("line")}) AS w FROM ls),
tf AS (SELECT doc_id, path, n, size, w, count(*) AS tf FROM ws GROUP BY ALL),
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM tf WHERE size = 1 AND w IN (SELECT w FROM t2) GROUP BY w),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT w FROM t2) LEFT JOIN df USING (w)),
t3 AS (SELECT tid, name, w, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY tid)) AS x FROM t2 JOIN idf USING (w)),
norms AS (SELECT doc_id, path, n, size, sqrt(sum(pow(tf * coalesce(idf, (SELECT avg(idf) FROM idf)), 2))) AS norm FROM tf LEFT JOIN idf USING (w) GROUP BY ALL),
dots AS (SELECT doc_id, path, n, size, tid, name, sum(tf * idf * x) AS dot FROM tf JOIN idf USING (w) JOIN t3 USING (w) GROUP BY ALL),
cos AS (SELECT doc_id, path, name, size, round(dot / norm, 9) AS score FROM dots JOIN norms USING (doc_id, path, n, size) WHERE dot / norm >= {THRESHOLD}),
own AS (SELECT doc_id, path, name, score FROM cos QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY size > 0, name = '{RESERVED}', score DESC, name) = 1),
held AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, name, score, path FROM own WHERE path LIKE '%/LICENSE-%'
         QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
up AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files ANTI JOIN own USING (doc_id)
       UNION ALL SELECT doc_id, path, regexp_replace(dir, '/?[^/]*$', '') FROM up WHERE dir <> '')
SELECT doc_id, path, name AS license, round(score, 6) AS score, CASE WHEN path LIKE '%/LICENSE-%' THEN 'file' ELSE 'header' END AS origin, path AS origin_path FROM own
UNION ALL SELECT up.doc_id, up.path, held.name, round(held.score, 6), 'inherited', held.path FROM up JOIN held USING (dir)
QUALIFY row_number() OVER (PARTITION BY up.doc_id ORDER BY length(dir) DESC) = 1"""


SQL = _sql()
