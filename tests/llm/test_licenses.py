import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pathlib import Path

from quern.llm.licenses import LINES, RESERVED, TEMPLATES, THRESHOLD, WHOLE, Templates, scan, word_sets

SCHEMA = "doc_id long, path string, text string, license string, score int"


def words(s):
    s = "".join(c.lower() if c.isascii() else c for c in s)
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", s)


def brute(rows):
    """Own licences by plain TF-IDF over all runs of lines, then inheritance by walking up."""
    bags = [(n, Counter(words(t))) for n, t in sorted(TEMPLATES)] + sorted(WHOLE.items())
    vocab = {w for _, b in bags for w in b}
    df = Counter(w for _, _, t in rows for w in set(words(t or "")) & vocab)
    idf = {w: math.log((1 + len(rows)) / (1 + df[w])) + 1 for w in vocab}
    other = sum(idf.values()) / len(idf)

    def vector(bag):
        v = {w: n * idf.get(w, other) for w, n in bag.items()}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()} if n else {}

    known = [(n, vector(b)) for n, b in bags]
    own, folders = {}, {}
    for d, p, t in rows:
        is_file = bool(p and re.search(r"(?i)(^|/)(un)?(licen[cs]e|copying)[^/]*$", p))
        ls = (t or "").split("\n")
        units = [(1, "\n".join(ls[i : i + k])) for k in LINES for i in range(len(ls) - k + 1)] + ([(0, t or "")] if is_file else [])
        found = []
        for head, u in units:
            v = vector(Counter(words(u)))
            for n, tv in known:
                c = sum(x * tv.get(w, 0) for w, x in v.items())
                if c >= THRESHOLD:
                    found.append((head, n == RESERVED, -round(c, 9), n))
        if found:
            best = min(found)
            own[d] = (best[3], "file" if is_file else "header", p)
            if is_file:
                f = p.rpartition("/")[0]
                folders[f] = min(folders.get(f, (0, "~", "")), (best[2], p, best[3]))
    out = dict(own)
    for d, p, _ in rows:
        if d in own or p is None:
            continue
        f = p
        while f:
            f = f.rpartition("/")[0]
            if f in folders:
                out[d] = (folders[f][2], "inherited", folders[f][1])
                break
    return out


MIT = """Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
ISC = """Copyright 2024 Some Body

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
SYSTEM = Path("/usr/share/common-licenses")


def test_whole_licence_files_are_found_without_their_title(spark):
    files = {"MIT": MIT, "ISC": ISC}
    for name, f, title in (("Apache-2.0", "Apache-2.0", 4), ("GPL-2.0", "GPL-2", 6), ("GPL-3.0", "GPL-3", 6), ("LGPL-2.1", "LGPL-2.1", 6), ("MPL-2.0", "MPL-2.0", 4), ("BSD-3-Clause", "BSD", 0)):
        if (SYSTEM / f).is_file():
            files[name] = "\n".join((SYSTEM / f).read_text().split("\n")[title:])
    if "BSD-3-Clause" in files:
        t = files["BSD-3-Clause"]
        files["BSD-2-Clause"] = t[: t.index("3. Neither")] + t[t.index("THIS SOFTWARE") :]
    filler = "some prose on rivers and hills\nand the copy of a map\n" * 30
    rows = [(k, f"{n}/LICENSE", t) for k, (n, t) in enumerate(sorted(files.items()))] + [(100 + k, f"{n}/deep/down/file.txt", filler) for k, n in enumerate(sorted(files))]
    rows += [(200, "p/essay.txt", filler + "The licence that people name most is the MIT one, they say, though the Apache and the GNU ones are read as often in these hills.\n" + filler)]
    rows += [(300 + k, "q/x.txt", filler) for k in range(200)]
    got = {r.doc_id: (r.license, r.origin) for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = {k: (n, "file") for k, n in enumerate(sorted(files))} | {100 + k: (n, "inherited") for k, n in enumerate(sorted(files))}
    assert got == want and len(files) >= 2


def test_notices_wrapped_over_lines_and_reserved_rights(spark):
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\ncode = 1"
    rows = [(1, "a.py", gpl), (2, "b.py", "Text here.\nAll rights reserved.\nmore"), (3, "c.py", "All rights reserved.\nReleased under the MIT License.")]
    rows += [(300 + k, "q/x.txt", "some prose on rivers and hills, the terms of trade") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert {r.doc_id: r.license for r in scan(df).collect()} == {1: "GPL-3.0", 2: RESERVED, 3: "MIT"}
    narrow = spark.createDataFrame([*rows[1:], (1, "a.py", "# it under the terms of the GNU General\n# Public License as published by the Free\n# Software Foundation, either version 3 of\n# the License, or\ncode = 1")], df.schema)
    assert {r.doc_id: r.license for r in scan(narrow).collect()}[1] == "GPL-3.0"


ROWS = [
    (1, "a/LICENSE", "The MIT License (MIT)\n\nCopyright (c) somebody"),
    (2, "a/x/one.py", "# nothing here\nprint(1)"),
    (3, "a/x/two.py", "# Licensed under the Apache License, Version 2.0.\ncode = 1"),
    (4, "a/x/y/COPYING.txt", "GNU General Public License, Version 3, 29 June 2007"),
    (5, "a/x/y/z/three.py", "no words on terms"),
    (6, "b/four.py", "This work is licensed under nothing at all, ever"),
    (7, "five.py", "released UNDER the mit license!"),
    (8, "b/c/LICENCE", "a poem on flowers and their gardens in spring"),
    (9, "b/c/six.py", "still nothing"),
    (10, "a/LICENSE.apache", "Licensed under the Apache License, Version 2.0 of course"),
    (11, "é/seven.txt", "Über uns: Licensed under CC BY-NC 4.0."),
    (12, "é/eight.txt", "Texte\nLicensed under CC BY-NC 4.0.\nencore"),
]


def test_same_as_plain_tf_idf_and_walking_up(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    got = {r.doc_id: (r.license, r.origin, r.origin_path) for r in scan(df).collect()}
    assert got == brute(ROWS)
    assert got[2] == ("Apache-2.0", "inherited", "a/LICENSE.apache") and got[1][0] == "MIT" and got[5][0] == "GPL-3.0" and got[3][1] == "header" and {6, 8, 9}.isdisjoint(got) and got[12][0] == "CC-BY-NC-4.0"


def test_each_wording_names_its_licence():
    t = Templates()
    t.weigh(np.zeros(len(t.vocab)), 1000)
    for n, wording in TEMPLATES:
        _, _, line, h, _ = next(word_sets(pa.array(["Before.\n" + wording])))
        _, pick, score = t.best(line, h, THRESHOLD)
        top = score.argmax()
        assert t.name[pick[top]] == n and score[top] > 0.99


def test_the_bound_on_runs_loses_none(monkeypatch):
    rng = random.Random(2)
    pool = sorted({w for b in WHOLE.values() for w in b})[::7] + ["license", "gnu", "public", "version"] + [f"x{i}" for i in range(60)]
    text = "\n".join(" ".join(rng.choice(pool) if rng.random() < 0.5 else w for w in words(rng.choice(TEMPLATES)[1])) for _ in range(400))
    t = Templates()
    t.weigh(np.zeros(len(t.vocab)), 100)
    _, _, line, h, row_of = next(word_sets(pa.array([text])))
    every = [t.best(*x, THRESHOLD) for x in t.runs(line, h, row_of, LINES, 0.0)]
    some = [t.best(*x, THRESHOLD) for x in t.runs(line, h, row_of, LINES, THRESHOLD)]
    assert sum(len(x[0]) for x in every) > 50
    for a, b in zip(every, some):
        assert all(np.allclose(x, y) for x, y in zip(a, b))


def test_defined_cases(spark):
    mit = "Released under the MIT License."
    long = "some words of prose " * 40000
    rows = [(1, None, mit), (2, None, "x"), (3, "d/f.py", None), (4, "d/g.py", ""), (None, "d/h.py", mit), (5, "e/f", mit), (5, "e/f", mit), (6, "f/LICENSE", mit), (7, "f/COPYING", mit), (8, "f/k.py", long), (9, "g.py", long + "\n" + mit)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted([(r.doc_id, r.license, r.origin, r.origin_path) for r in scan(df).collect()], key=str)
    want = [(None, "MIT", "header", "d/h.py"), (1, "MIT", "header", None), (5, "MIT", "header", "e/f"), (5, "MIT", "header", "e/f"), (6, "MIT", "file", "f/LICENSE"), (7, "MIT", "file", "f/COPYING"), (8, "MIT", "inherited", "f/COPYING"), (9, "MIT", "header", "g.py")]
    assert got == sorted(want, key=str)
    assert scan(df.limit(0)).collect() == []
