import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import llm_brute as B
from slotlake.llm import queries, spelling


def counts(rows, noise=199, shortest=6, least=5):
    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def near_words(words):
    """By what is left when one letter is blanked out or taken out."""
    groups, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            groups[w[:i], w[i + 1:]].add(w)
    for group in groups.values():
        for a in group:
            near[a] |= group - {a}
    have = set(words)
    for w in words:
        for v in {w[:i] + w[i + 1:] for i in range(len(w))} & have:
            near[w].add(v)
            near[v].add(w)
    return near


def brute(n, ratio=5):
    near, form = near_words(list(n)), {}
    for w, vs in near.items():
        if vs and n[best := min(vs, key=lambda v: (-n[v], v))] >= ratio * n[w]:
            form[w] = best
    out = []
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, c, len(near[w]), n[form[w]] if w in form else None))
    return out


def test_plain_versions_agree():
    words = [a + b + c for a in ("", "x", "é") for b in ("ab", "ba", "b") for c in ("", "a", "bb")]
    words = sorted(set(words) - {""})
    near = near_words(words)
    assert all((b in near[a]) == one_edit(a, b) for a in words for b in words if a != b)


def test_neighbours_of_random_words(spark):
    draw = np.random.default_rng(5)
    words = {"".join(draw.choice(list("abé"), draw.integers(1, 9))) for _ in range(900)}
    words |= {"x" * k for k in range(1, 14)} | {"long" * 60 + e for e in ("", "a", "ab", "ba")} | {"l" + "ong" * 300, "ong" * 300}
    got = spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    want = {(a, b) for a, bs in near_words(words).items() for b in bs}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_forms_and_roots(spark):
    n = {"colour": 1000, "color": 200, "colur": 40, "clur": 8, "cplour": 5, "colouur": 200, "other": 3, "othex": 3, "otheq": 15}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    assert B.counted(rows) == B.counted(brute(n))
    assert {r.word: r.root for r in rows}["clur"] == "colour"


def test_awkward_rows(spark):
    letters = [(20 + i, "naïveté naÏveté Straße straßen " + "w" * 3000 + " " + "w" * 2999, "a") for i in range(6)]
    rows = B.AWKWARD + letters
    got = spelling.variants(spelling.vocabulary(B.awkward(spark, rows), noise=3)).collect()
    assert B.counted(got) == B.counted(brute(counts(rows, noise=3)))
    assert spelling.variants(spelling.vocabulary(B.awkward(spark).limit(0))).count() == 0


def test_query(spark, docs_dir, doc_rows):
    got = queries.QUERIES["op12_spelling"](spark, docs_dir).collect()
    assert B.counted(got) == B.counted(brute(counts(doc_rows)))
