"""Licence scans against brute force over every line, block and text, without any prefilter, and licences that are easily mistaken."""

import math
import random
import re

import pytest

from waveloom.llm import licenses

TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
PLAIN = "the of to and in is for on with that this by from or an are be as at work time people code general source free public".split()


def brute(texts, templates, threshold):
    """Licence and score of each text: all units against all templates."""
    tokens = lambda t: TOKEN.findall(t.lower())
    forms = [(name, tokens(t)) for name, own in sorted(templates.items()) for t in ([own] if isinstance(own, str) else own)]
    n, met, inside = len(texts) + len(forms), {}, {}
    for t in texts:
        for w in set(tokens(t)):
            met[w] = met.get(w, 0) + 1
    for _, f in forms:
        for w in set(f):
            inside[w] = inside.get(w, 0) + 1
    rarity = lambda w: math.log((1 + n) / (1 + met.get(w, 0) + inside.get(w, 0))) + 1
    vector = lambda ws: {w: ws.count(w) * rarity(w) for w in set(ws)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = [(name, vector(f)) for name, f in forms]
    out = []
    for t in texts:
        best = None
        for unit in [*t.split("\n"), *[b for b in re.split(r"\n[^\w\n]*(?=\n)", t) if "\n" in b.strip()], t]:
            v = vector(tokens(unit))
            if v:
                for name, f in own:
                    s = round(sum(x * f.get(w, 0) for w, x in v.items()) / norm(v) / norm(f), 6)
                    if s >= threshold and (best is None or (-s, name) < best):
                        best = (-s, name)
        out.append((best[1], -best[0]) if best else (None, None))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_equals_brute_force_without_a_prefilter(spark, threshold):
    rng = random.Random(int(threshold * 10))
    templates = {"x": "foo bar baz qux quux corge", "y": ("the general public work of free people", "one and one and one only"), "z": "Grüße aus Köln v1.2-rc"}
    pool = PLAIN * 3 + sorted({w for t in templates.values() for p in ([t] if isinstance(t, str) else t) for w in TOKEN.findall(p)}) * 2
    texts = ["\n".join(" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 5))) for _ in range(250)]
    texts += [t if isinstance(t, str) else t[0] for t in templates.values()] + ["FOO bar\nbaz QUX\n\nquux corge", ""]
    got = licenses.scanned(spark.createDataFrame([(k, f"p{k}", t) for k, t in enumerate(texts)], "doc_id long, path string, text string"), threshold, templates=templates).collect()
    found = {r["doc_id"]: (r["licence"], r["score"]) for r in got if r["how"] == "own"}
    want = brute(texts, templates, threshold)
    for k, (name, score) in enumerate(want):
        assert (k in found) == (name is not None), (texts[k], name, score)
        assert name is None or abs(found[k][1] - score) < 2e-6
    assert sum(w[0] is not None for w in want) >= 4


def test_telling_words_leave_less_than_the_threshold():
    rng = random.Random(4)
    for _ in range(200):
        parts = {f"w{k}": rng.random() for k in range(rng.randrange(1, 30))}
        size = math.sqrt(sum(x * x for x in parts.values()))
        parts = {w: x / size for w, x in parts.items()}
        chosen = licenses.telling([parts], {w: rng.randrange(100) for w in parts}, 0.6)
        assert math.sqrt(sum(x * x for w, x in parts.items() if w not in chosen)) < 0.6


def test_licences_that_are_easily_mistaken(spark):
    rng = random.Random(6)
    texts = [licenses.TEMPLATES[k][1] for k in ("agpl-3.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0")]
    texts += ["# SPDX-License-Identifier: (MIT OR Apache-2.0)\nx = 1", "// SPDX-License-Identifier: AGPL-3.0-only", "/* SPDX-License-Identifier: GPL-2.0-only WITH MIT */", "SPDX-License-Identifier: LicenseRef-Own", "SPDX-License-Identifier: lgpl-2.1-or-later AND bsd-3-clause"]
    texts += [" ".join(rng.choice(PLAIN) for _ in range(40)) for _ in range(300)]
    got = {r["doc_id"]: (r["licence"], r["how"]) for r in licenses.scanned(spark.createDataFrame([(k, f"p{k}", t) for k, t in enumerate(texts)], "doc_id long, path string, text string")).collect()}
    assert [got[k][0] for k in range(6)] == ["agpl-3.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0"]
    assert [got[k][0] for k in range(6, 11)] == ["mit OR apache-2.0", "agpl-3.0", "gpl-2.0 WITH mit", None, "lgpl-2.1 AND bsd-3-clause"]
    assert all(got[k] == (None, "none") for k in range(11, len(texts)))
