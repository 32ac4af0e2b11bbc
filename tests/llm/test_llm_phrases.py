import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import llm_brute as B
from slotlake.llm import phrases, queries


def brute(rows, longest=5, least=100, limit=2000):
    """Rows (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p in often:
            a = counts[p]
            inside = any(len(q) > len(p) and counts[q] >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q in often)
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(found[:limit])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(t, g, "x", 1, 2) for t, g in rows], "text string, lang string, phrase string, n int, part int")


@pytest.fixture
def random_rows():
    draw = np.random.default_rng(2)
    words = ["a", "b", "c", "É", "漢", "x\x1cy", "up-to", "D"]
    rows = [(" ".join(draw.choice(words, draw.integers(0, 60), p=[.3, .2, .2, .1, .1, .04, .03, .03])) + str(draw.choice(["", ".", "! a b", "\r\n", "\t"])),
             [None, "en", "und", "de"][draw.integers(4)]) for _ in range(400)]
    return rows + [(None, None), ("", "en"), (None, "xx"), (" \t ;;", "en"), ("to be or not to be. " * 300, "fr"), ("z " * 3000, "fr")]


@pytest.mark.parametrize("least, longest, limit", [(20, 5, 2000), (5, 3, 30), (100, 2, 7)])
def test_random_texts(spark, random_rows, least, longest, limit):
    got = phrases.collocations(frame(spark, random_rows), longest, least, limit)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert B.counted(got.collect()) == B.counted(brute(random_rows, longest, least, limit))


def test_small_blocks_and_a_small_filter_change_nothing(spark, random_rows, monkeypatch):
    want = B.counted(brute(random_rows, least=10))
    for name, value in (("WORDS", 500), ("TEXTS", 300), ("MOST_BITS", 16)):
        monkeypatch.setattr(phrases, name, value)
    assert B.counted(phrases.collocations(frame(spark, random_rows), least=10).collect()) == want


def test_filter_holds_what_was_put_in(spark):
    grams = spark.createDataFrame([("en", "a b"), ("de", "é 漢")], "lang string, phrase string")
    found = phrases.Filter.of(grams)
    hashes = lambda lang, text: phrases.Filter.hashes(
        phrases.Filter.start(lang), [np.array([phrases.xxhash.xxh64_intdigest(w)], np.uint64) for w in text.encode().split()])
    assert found.may_hold(hashes("en", "a b"))[0] and found.may_hold(hashes("de", "é 漢"))[0]
    assert not found.may_hold(hashes("de", "a b"))[0] and not found.may_hold(hashes("en", "b a"))[0]


def test_products_beyond_64_bits(spark):
    a, n, l, r = 4 * 10**15 + 1, 9 * 10**16 + 7, 5 * 10**15 + 3, 6 * 10**16 + 1
    grams = spark.createDataFrame([("en", "a b", 2, a)], "lang string, phrase string, size int, a long")
    counts = spark.createDataFrame([("en", "a", l), ("en", "b", r)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    assert phrases.scored(grams, counts, totals).first().score == 1000 * a * n // (l * r)


def test_no_rows_and_awkward_rows(spark):
    assert phrases.collocations(frame(spark, [("a", "b")]).limit(0)).count() == 0
    rows = [(t, "en") for _, t, _ in B.AWKWARD]
    assert B.counted(phrases.collocations(B.awkward(spark), least=2).collect()) == B.counted(brute(rows, least=2))


def test_query(spark, docs_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{docs_dir}/documents.parquet").select("text", "lang").collect()]
    assert B.counted(queries.QUERIES["op13_phrases"](spark, docs_dir).collect()) == B.counted(brute(rows))
