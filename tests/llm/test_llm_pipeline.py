"""The pipeline against plain versions of its stages; toxicity and mixture by what they promise."""

import os
from collections import Counter, defaultdict

import llm_brute as B
import corpus_pipeline
from slotlake.llm import simhash, toxicity


def kept_once(rows):
    best = {}
    for d, t, s in rows:
        best[t or ""] = max(best.get(t or "", (-1,)), (d, t, s), key=lambda r: r[0])
    return list(best.values())


def shingles(text):
    words = [w.encode() for w in B.WORD.findall(B.re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def near_links(rows):
    """Pairs of rows with five-word Jaccard of 0.8 or more, by what they share; rows without words are alike."""
    sets, where, links = [shingles(r[1]) for r in rows], defaultdict(list), []
    for i, found in enumerate(sets):
        shared = Counter(j for s in found for j in where[s])
        links += [(i, j) for j, n in shared.items() if 5 * n >= 4 * (len(found) + len(sets[j]) - n)]
        for s in found or {()}:
            where[s].append(i)
        if not found:
            links += [(i, j) for j in where[()][:-1]]
    return links


def nearest(rows):
    ids = [r[0] for r in rows]
    return [r for r, c in zip(rows, B.smallest(ids, B.classes(len(rows), near_links(rows)))) if r[0] == c]


def grouped(found):
    """Sets of ids of equal root."""
    groups = defaultdict(set)
    for r in found.collect():
        groups[r.root].add(r.doc_id)
    return groups.values()


def test_recall_of_leaders(spark, docs_dir):
    """On all documents, and on a group whose texts are all near 0.8, some above and most below."""
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    base, draw = [f"w{i}" for i in range(200)], B.np.random.default_rng(6)
    hard = []
    for d in range(200):
        words = list(base)
        for i in draw.choice(200, 2 + int(draw.integers(2)), replace=False):
            words[i] = f"x{d}_{i}"
        hard.append((d, " ".join(words)))
    for rows in ([tuple(r) for r in docs.select("doc_id", "text").collect()], hard):
        links = near_links(rows)
        root = dict(zip([r[0] for r in rows], B.classes(len(rows), links)))
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        leaders = grouped(simhash.similar_by_leaders(frame))
        place = {d: i for i, g in enumerate(leaders) for d in g}
        joined = sum(place[rows[i][0]] == place[rows[j][0]] for i, j in links)
        assert all(len({root[d] for d in g}) == 1 for g in leaders) and joined >= 0.9 * len(links)
        print("recall of links", joined, len(links))


def test_near_stage_loses_no_link(spark):
    """Groups whose texts are all near 0.8, so that most of a text's partners are just short of it; short texts; lone links."""
    draw, rows = B.np.random.default_rng(7), []
    for length, times, changes in ((200, 150, 3), (60, 100, 2), (12, 60, 1), (700, 40, 9)):
        for _ in range(times):
            words = [f"{length}w{i}" for i in range(length)]
            for i in draw.choice(length, changes - int(draw.integers(2)), replace=False):
                words[i] = f"x{len(rows)}_{i}"
            rows.append((len(rows), " ".join(words), "s"))
    for n in range(5, 45):  # n - 4 shingles and a few more behind them, as many as just reach 0.8 or just miss it
        for more in ((n - 4) // 4, (n - 4) // 4 + 1):
            words = [f"{n}_{more}y{i}" for i in range(n + more)]
            rows += [(len(rows), " ".join(words), "s"), (len(rows) + 1, " ".join(words[:n]), "s")]
    got = simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    want = nearest(rows)
    assert B.counted(tuple(r) for r in got.collect()) == B.counted(want) and len(want) < len(rows) - 100


def test_near_stage_writes_parities_once_a_text(spark, monkeypatch):
    """They are its longest column; texts that share many parts do not have them written again for each part."""
    draw, rows, written = B.np.random.default_rng(8), [], {}
    for d in range(600):
        words = [f"{d // 20}w{i}" for i in range(400)]
        for i in draw.choice(400, 15, replace=False):
            words[i] = f"x{d}_{i}"
        rows.append((d, " ".join(words)))

    def noted(df, name, freeze=simhash.freeze):
        out = freeze(df, name)
        written[name] = max(written.get(name, 0), sum(os.path.getsize(f.removeprefix("file:").replace("//", "/")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "freeze", noted)
    simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).count()
    by_part = sum(written.get(name, 0) for name in ("postings", "drawn", "leaders", "placed"))
    assert 0 < by_part < written["parts"]


def test_near_stage_compares_fingerprints(spark, monkeypatch):
    """Over the tables of distances; pairs within two bits are candidates, whatever parts they share, and the sets decide."""
    draw, rows = B.np.random.default_rng(9), []
    for d in range(300):
        words = [f"{d // 3}w{i}" for i in range(900)]
        for i in draw.choice(900, d % 3, replace=False):
            words[i] = f"x{d}_{i}"
        rows.append((d, " ".join(words)))
    rows += [(300 + i, " ".join(t.split()[::-1])) for i, (_, t) in enumerate(rows[:9])] + [(400, None), (401, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    tables, real = [], simhash.pivot_table
    monkeypatch.setattr(simhash, "pivot_table", lambda *args: tables.append(args) or real(*args))
    groups = grouped(simhash.similar(frame))
    assert len(tables) == 1 and sorted(map(sorted, groups)) == sorted(map(sorted, connected(rows)))
    found = simhash.shingle_sets(frame, {}).where("n > 0").select("doc_id", "key", "n", "fp", "odd").collect()
    ids, prints = {r.key: r.doc_id for r in found}, {r.key: r.fp for r in found}
    pairs = simhash.print_pairs(spark.createDataFrame(found).select("key", "n", "fp", "odd").distinct()).collect()
    keys = sorted(ids)
    within = [(i, j) for j, b in enumerate(keys) for i, a in enumerate(keys[:j]) if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= simhash.DISTANCE]
    root = B.classes(len(keys), [(keys.index(r.a), keys.index(r.b)) for r in pairs])
    alike = [(i, j) for i, j in within if root[i] == root[j]]
    linked = {frozenset((rows[i][0], rows[j][0])) for i, j in near_links(rows)}
    assert {(keys.index(r.a), keys.index(r.b)) for r in pairs} <= set(within) and len(alike) > 50
    assert all(p in alike for p in within if frozenset(ids[keys[i]] for i in p) in linked)


def connected(rows):
    """Sets of ids that links connect."""
    groups = defaultdict(set)
    for (d, *_), root in zip(rows, B.classes(len(rows), near_links(rows))):
        groups[root].add(d)
    return groups.values()


def test_sets_of_the_similarity_share_a_part():
    """And differ in no more parities than shingles."""
    draw, checked = B.np.random.default_rng(1), 0
    fresh = lambda n: draw.integers(0, 2**63, n, dtype=B.np.uint64)
    for size in (2 ** draw.uniform(0, 9, 4000)).astype(int).tolist():
        a = fresh(size)
        b = B.np.unique(B.np.concatenate([a[int(draw.integers(size // 5 + 1)):], fresh(int(draw.integers(size // 4 + 2)))]))
        a = B.np.unique(a)
        both, either = len(B.np.intersect1d(a, b)), len(B.np.union1d(a, b))
        bits = int(B.np.unpackbits((simhash.parities(a) ^ simhash.parities(b)).view(B.np.uint8)).sum())
        assert bits <= either - both
        if 5 * both >= 4 * either:
            parts = [simhash.part_keys(x, (x % B.np.uint64(5)).astype(B.np.int64)) for x in (a, b)]
            assert len(B.np.intersect1d(*parts)), (len(a), len(b))
            checked += 1
    assert checked > 1000


def test_stages(spark, docs_dir, doc_rows):
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash", "mixture", "byte_bpe"]
    clean = stages["toxicity"](spark, docs, docs_dir)
    model = toxicity.fit(toxicity.training_set(docs, spark.read.parquet(f"{docs_dir}/labels.parquet")))
    rows = [r for r in doc_rows if toxicity.score_text(r[1] or "", model) < 0.5]
    plain = lambda df: [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    assert clean.columns == docs.columns and B.counted(plain(clean)) == B.counted(rows) and len(rows) < len(doc_rows)
    exact = stages["exact_dedup"](spark, clean, docs_dir)
    rows = kept_once(rows)
    assert exact.columns == docs.columns and B.counted(plain(exact)) == B.counted(rows)
    near = stages["simhash"](spark, exact, docs_dir)
    rows = nearest(rows)
    assert near.columns == docs.columns and B.counted(plain(near)) == B.counted(rows)
    mixed = stages["mixture"](spark, near, docs_dir)
    assert mixed.columns == docs.columns
    taken = Counter(plain(mixed))
    assert set(taken) <= set(rows) and max(taken.values()) <= 2
    goal, words = B.targets(sizes(rows)), defaultdict(int)
    for (_, t, s), n in taken.items():
        words[s] += n * len(B.WORD.findall(t or ""))
    widest = max(len(B.WORD.findall(t or "")) for _, t, _ in rows)
    assert all(abs(words[s] - goal[s]) <= max(widest, 0.05 * goal[s]) for s in goal)
    ids = dict(zip(rows, B.rank_ids([t for _, t, _ in rows])))
    want = Counter()
    for row, n in taken.items():
        want[(row[0], row[2], tuple(ids[row]))] += n
    run = corpus_pipeline.run(spark, docs_dir)
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in run.collect()) == want


def sizes(rows):
    out = defaultdict(int)
    for _, t, s in rows:
        out[s] += len(B.WORD.findall(t or ""))
    return dict(out)


def test_no_documents(spark, docs_dir):
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, docs_dir).count() == 0, name
