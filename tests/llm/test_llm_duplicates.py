from collections import Counter, defaultdict

import numpy as np
import pytest

import llm_brute as B
from slotlake.llm import embedding_dedup, exact_dedup, queries, simhash, substring_dedup
from slotlake.llm.components import components


def exact_rows(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    keep = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
    return [(d, keep[t or ""], len(groups[t or ""]), d == keep[t or ""], B.sha(t or "")) for d, t, *_ in rows]


@pytest.mark.parametrize("bits", [1 << 30, 1 << 13])
def test_exact_report(spark, bits):
    """Also with filters too small for the rows: several slices, many suspects, the same result."""
    got = exact_dedup.duplicate_report(B.awkward(spark), filter_bits=bits)
    assert B.counted(got.collect()) == B.counted(exact_rows(B.AWKWARD))


def test_exact_drop_keeps_one_row_a_text_with_all_columns(spark):
    docs = B.awkward(spark)
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    want = {(k, t) for (d, t, _), (_, k, *_) in zip(B.AWKWARD, exact_rows(B.AWKWARD)) if d == k}
    assert B.counted((r.doc_id, r.text or "") for r in got.collect()) == Counter({(d, t or "") for d, t in want})


def test_filter_lets_rows_without_a_copy_pass(spark):
    rows = spark.range(20000).selectExpr("xxhash64(id) AS h", "id")
    twice = rows.unionByName(rows.where("id < 50"))
    marked = exact_dedup.mark_repeated(twice)
    assert marked.where("id < 50 AND NOT suspect").count() == 0
    assert marked.where("id >= 50 AND suspect").count() < 600
    found = exact_dedup.mark_members(rows, rows.where("id % 100 = 0").select("h"))
    assert found.where("id % 100 = 0 AND NOT suspect").count() == 0 and found.where("suspect").count() < 2000


def test_exact_query(spark, docs_dir, doc_rows):
    assert B.counted(queries.QUERIES["op2_exact_dedup"](spark, docs_dir).collect()) == B.counted(exact_rows(doc_rows))


def test_levels():
    assert substring_dedup.levels(50) == [13, 25, 50] and substring_dedup.levels(12) == [12] and substring_dedup.levels(100) == [13, 25, 50, 100]


def test_passages_of_awkward_rows(spark):
    got = substring_dedup.remove_repeats(B.awkward(spark)).drop("removed")
    assert B.counted(got.collect()) == B.counted(B.passages([r[:2] for r in B.AWKWARD]))


def test_passages_at_random(spark):
    """Pieces of a few passages, so that windows repeat with all offsets; also repeats inside one document."""
    draw = np.random.default_rng(3)
    pool = [[f"{c}{i}" for i in range(160)] for c in "abcd"]
    rows = []
    for d in range(60):
        words = []
        for _ in range(draw.integers(0, 5)):
            p, a = pool[draw.integers(4)], int(draw.integers(0, 110))
            words += p[a:a + int(draw.integers(1, 140))] + [f"u{draw.integers(50)}"] * int(draw.integers(0, 3))
        rows.append((int(draw.integers(0, 50)), " ".join(words)))
    ids = list(dict.fromkeys(r[0] for r in rows))
    rows = [next(r for r in rows if r[0] == d) for d in ids]
    for words in (50, 20, 7):
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), words=words)
        assert B.counted(got.drop("removed").collect()) == B.counted(B.passages(rows, words)), words
        assert all(r.n_removed == sum(s["end"] - s["first"] for s in r.removed) for r in got.collect())


def test_substring_query(spark, docs_dir, doc_rows):
    got = queries.QUERIES["op5_substring_dedup"](spark, docs_dir).collect()
    assert B.counted(got) == B.counted(B.passages([r[:2] for r in doc_rows]))


def simhash_rows(rows):
    prints = [B.fingerprint(t) for _, t, *_ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    return [(d, f"{p:016x}", c) for (d, *_), p, c in zip(rows, prints, B.smallest([r[0] for r in rows], B.classes(len(rows), links)))]


def test_simhash_of_awkward_rows(spark):
    got = simhash.link(B.awkward(spark)).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0'))", "component_id")
    assert B.counted(got.collect()) == B.counted(simhash_rows(B.AWKWARD))
    assert simhash.link(B.awkward(spark).limit(0)).count() == 0


def test_simhash_query(spark, docs_dir, doc_rows):
    assert B.counted(queries.QUERIES["op6_simhash"](spark, docs_dir).collect()) == B.counted(simhash_rows(doc_rows))


@pytest.mark.parametrize("crowd", [32, 2])
def test_pivots_lose_no_link(spark, monkeypatch, crowd):
    """Random fingerprints and clouds around some: compared in pairs, and over midpoints."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = np.random.default_rng(5)
    points = [int(x) for x in draw.integers(0, 1 << 63, 150)]
    for centre in points[:4] + [0]:
        for _ in range(70):
            flipped = centre
            for b in draw.integers(0, 64, draw.integers(1, 4)):
                flipped ^= 1 << int(b)
            points.append(flipped)
    points = sorted({p - (1 << 64) if p >= 1 << 63 else p for p in points})
    links = simhash.near_classes(spark.createDataFrame([(p,) for p in points], "fp long"))
    got = {r.node: r.component for r in components(links).collect()}
    pairs = [(i, j) for i in range(len(points)) for j in range(i) if bin((points[i] ^ points[j]) & (1 << 64) - 1).count("1") <= 2]
    want = dict(zip(points, B.smallest(points, B.classes(len(points), pairs))))
    assert {p: got.get(p, p) for p in points} == want


def test_keep_one_leaves_one_row_of_each_component(spark):
    docs = B.awkward(spark)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    want = {c for _, _, c in simhash_rows(B.AWKWARD)}
    assert Counter(r.doc_id for r in got.collect()) == Counter(want)


def test_keep_one_loses_no_row_without_an_own_id(spark):
    """Null and repeated ids with unrelated texts: each text is a component and stays."""
    rows = [(d, " ".join(f"{c}{i}" for i in range(30))) for d, c in [(None, "p"), (None, "q"), (None, "q"), (7, "r"), (7, "s"), (8, "s"), (9, "t")]]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert B.counted(got) == B.counted([rows[0], rows[1], rows[3], rows[4], rows[6]])


def five_words(text):
    ws = B.WORD.findall((text or "").lower())
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def similar_rows(rows):
    """Brute force: rows of the smallest id of each component under Jaccard 0.8 of five-word shingles."""
    sets = [five_words(t) for _, t in rows]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    roots = B.classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])])
    least = {}
    for (d, t), r in zip(rows, roots):
        row = (d is None, d or 0, t or "")
        least[r] = min(least.get(r, row), row)
    return [(None if none else d, t) for none, d, t in least.values()]


@pytest.mark.parametrize("exact", [True, False])
def test_similar_keeps_one_by_jaccard(spark, docs_dir, doc_rows, exact):
    """Near copies of many distances around a few texts, chains of them, unrelated texts, null ids, and the documents."""
    draw = np.random.default_rng(11)
    rows = [(None, None), (901, ""), (902, "One two"), (903, "one TWO"), (904, "one three")]
    for c in range(6):
        words = [f"{c}w{i}" for i in range(int(draw.integers(40, 160)))]
        for k in range(25):
            for at in draw.integers(0, len(words), int(draw.integers(0, 4))):
                words = words[:at] + [f"x{draw.integers(10**9)}"] + words[at + 1:]
            rows.append((100 * c + k, " ".join(words)))
    rows.append((None, " ".join(f"y{i}" for i in range(20))))
    rows += sorted({t: (1000 + d, t) for d, t, _ in doc_rows if t}.values())
    got = simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string"), exact=exact).collect()
    want = similar_rows(rows)
    assert B.counted((r.doc_id, r.text or "") for r in got) == B.counted(want) and len(want) < len(rows) - 50


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(1000, 1001), (7000, 7000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def embedding_rows(rows, threshold=0.9):
    x, ok = [], []
    for _, v in rows:
        good = v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
        ok.append(good)
        x.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None)
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold]
    n = Counter(i for pair in links for i in pair)
    component = B.smallest([r[0] for r in rows], B.classes(len(rows), links))
    return [(r[0], n[i], component[i], r[0] == component[i]) for i, r in enumerate(rows)]


def test_embeddings(spark, monkeypatch):
    """A crowd around one point in many blocks, copies, and vectors that link with nothing."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    draw = np.random.default_rng(2)
    centre = draw.standard_normal(16)
    rows = [(i, [float(c) for c in draw.standard_normal(16)]) for i in range(120)]
    rows += [(200 + i, [float(c) for c in centre + 0.12 * draw.standard_normal(16)]) for i in range(90)]
    rows += [(400 + i, rows[3][1]) for i in range(40)] + [(500, [2 * c for c in rows[3][1]])]
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [None] + [1.0] * 15), (604, [float("nan")] * 16), (605, [float("inf")] + [1.0] * 15),
             (606, [1.0, 2.0]), (607, [2.0, 4.0]), (3, rows[3][1])]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = embedding_rows(rows)
    found, there = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert found <= there and found >= 0.99 * there
    assert B.counted(r[:1] + r[2:] for r in map(tuple, got)) == B.counted((w[0], *w[2:]) for w in want)
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_plan_of_tables():
    for n in (10, 50_000, 1_000_000_000):
        k, tables = embedding_dedup.plan(n)
        near = embedding_dedup.meeting(np.sqrt(0.2)) ** k
        assert 1 - (1 - near) ** tables >= embedding_dedup.RECALL
        assert n * embedding_dedup.meeting(np.sqrt(2)) ** k <= embedding_dedup.BUCKET * 1.01 or k == 4


def test_embeddings_query(spark, docs_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{docs_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert B.counted(queries.QUERIES["op9_embeddings"](spark, docs_dir).collect()) == B.counted(embedding_rows(rows))
