import math
import random
from pathlib import Path

import pytest

from retail_lake.llm import licence_texts
from retail_lake.llm.licences import LEAST, TEMPLATES, _wording, licences, match, statements, weights

SCHEMA = "doc_id long, path string, text string, dir string"
MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
FILES = [
    (1, "LICENSE", MIT, "z"),
    (2, "a/LICENSE", f"Notes\n{GPL}\nmore", "z"),
    (3, "a/b/c.txt", "plain text", "z"),
    (4, "a/b/d.txt", f"text\n{MIT}\ntext", None),
    (5, "e/f.txt", None, "z"),
    (6, None, "", "z"),
    (7, None, f"{GPL}", "z"),
    (8, "top.txt", "licence of another kind entirely and at length", "z"),
    (9, "a/b/c.txt", "plain text", "z"),
    (10, "a/x.txt", "long " * 30_000 + f"\n{GPL}", "z"),
]


def test_own_and_inherited(spark):
    got = {r["doc_id"]: (r["own_licence"], r["licence"], r["from_dir"]) for r in licences(spark.createDataFrame(FILES, SCHEMA), "path", "text", "doc_id").collect()}
    gpl, mit = "GPL-3.0", "MIT"
    assert got == {
        1: (mit, mit, None),
        2: (gpl, gpl, None),
        3: (None, gpl, "a"),
        4: (mit, mit, None),
        5: (None, mit, ""),
        6: (None, None, None),
        7: (gpl, gpl, None),
        8: (None, mit, ""),
        9: (None, gpl, "a"),
        10: (gpl, gpl, None),
    }


def test_exact_statements_have_cosine_one(spark):
    rows = licences(spark.createDataFrame(FILES, SCHEMA), "path", "text", "doc_id").filter("doc_id in (1, 7)").collect()
    assert [r["own_score"] for r in rows] == [1.0, 1.0]


def test_empty_table(spark):
    assert licences(spark.createDataFrame([], SCHEMA), "path", "text", "doc_id").count() == 0


def _commented(text, mark):
    return "import os\n\n" + "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n")) + "\n\nprint(os.name)\n"


def _wrapped(text, width=70):
    out = [""]
    for word in text.split():
        if len(out[-1]) + len(word) >= width:
            out.append("")
        out[-1] = f"{out[-1]} {word}".strip()
    return "\n".join(out)


def _file(*parts):
    return "\n\n".join(_wrapped(p) for p in parts)


T = licence_texts
RIGHTS = "Copyright (c) 2020, Some Person and the Others. All rights reserved."
MIT_FILE = _file(RIGHTS, T._MIT_GRANT, T._MIT_NOTICE, T._MIT_WARRANTY)
BSD_2 = _file(RIGHTS, T._BSD_USE, T._BSD_TWO, T._BSD_WARRANTY)
BSD_3 = _file(RIGHTS, T._BSD_USE, T._BSD_TWO, T._BSD_THREE, T._BSD_WARRANTY)


def test_whole_texts_and_wrapped_headers(spark):
    gnu = T._GNU_HEADER.format("", 3)
    cases = [
        ("LICENSE", MIT_FILE, "MIT"),
        ("LICENSE-MIT", "MIT License\n\n" + MIT_FILE, "MIT"),
        ("COPYING", BSD_2, "BSD-2-Clause"),
        ("COPYING.md", BSD_3, "BSD-3-Clause"),
        ("a.py", _commented(BSD_2, "#"), "BSD-2-Clause"),
        ("b.c", _commented(BSD_3, " *"), "BSD-3-Clause"),
        ("c.js", _commented(MIT_FILE, "//"), "MIT"),
        ("d.py", _commented(_file(RIGHTS, T._APACHE_HEADER), "#"), "Apache-2.0"),
        ("e.py", _commented(_wrapped(gnu, 40), "#"), "GPL-3.0"),
        ("f.py", "# Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "MIT"),
        ("g.py", "# Released under the Foo License.", None),
        ("h.py", "# All rights reserved.\n# MIT License", "MIT"),
        ("i.py", "# " + RIGHTS.replace("Copyright (c) 2020, Some Person and the Others. ", ""), "Proprietary"),
        ("j.py", "to be or not to be, that is the question of this work and the person", None),
    ]
    known = Path("/usr/share/common-licenses")
    for name, key in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if (known / name).exists():
            cases.append((f"{name}/LICENSE", (known / name).read_text(), key))
            cases.append((f"{name}/x.txt", "x " + (known / name).read_text(), key))
    rows = [(i, f"p{i}/{path}", text, "z") for i, (path, text, _) in enumerate(cases)]
    got = {r["doc_id"]: r["own_licence"] for r in licences(spark.createDataFrame(rows, SCHEMA), "path", "text", "doc_id").collect()}
    assert {cases[i][0]: x for i, x in got.items()} == {path: want for path, _, want in cases}


def test_scores_against_all_templates(spark):
    """No statement is lost to the rare words and lengths by which templates are looked up."""
    rng = random.Random(3)
    weight, other = weights()
    words = [t for _, text in TEMPLATES for t in _wording(text)]
    lines = []
    for _ in range(400):
        own = _wording(rng.choice(TEMPLATES)[1])
        kept = rng.sample(own, rng.randint(1, len(own)))
        lines.append(" ".join(kept + rng.sample(words, rng.randint(0, 4)) + [f"new{i}" for i in range(rng.randint(0, 6))]))
    files = spark.createDataFrame([(str(i), str(i), line) for i, line in enumerate(lines)], "path string, digest string, text string")
    stated = statements(files).cache()
    found = {r["path"]: (r["licence"], r["score"]) for r in stated.select("path", "sid").join(match(stated), "sid").collect()}
    want = {}
    for i, line in enumerate(lines):
        terms = set(line.split())
        length = sum(weight.get(t, other) for t in terms)
        best = None
        for name, text in TEMPLATES:
            own = set(_wording(text))
            score = sum(weight[t] for t in terms & own) / math.sqrt(length * sum(weight[t] for t in own))
            if score >= LEAST and (best is None or score > best[1] + 1e-9):
                best = (name, score)
        if best:
            want[str(i)] = best
    assert len(want) > 50 and set(found) == set(want)
    for path, (name, score) in want.items():
        assert found[path] == (name, pytest.approx(score, abs=2e-6))


def test_equal_paths_and_scores(spark):
    """Rows of one path and text are alike; of two licences said equally, the last in the alphabet."""
    both = "Licensed under the MIT License.\nLicensed under the ISC License."
    rows = [(1, "a/LICENSE", both, "z"), (2, "a/LICENSE", both, "z"), (3, "a/LICENSE", "", "z"), (4, "a/x", "", "z")]
    got = sorted(tuple(r) for r in licences(spark.createDataFrame(rows, SCHEMA), "path", "text", "doc_id").select("doc_id", "own_licence", "licence").collect())
    assert got == [(1, "MIT", "MIT"), (2, "MIT", "MIT"), (3, None, "MIT"), (4, None, "MIT")]
