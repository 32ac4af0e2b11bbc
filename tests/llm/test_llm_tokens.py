import hashlib

import public_tokenizers as P
import pytest

import llm_brute as B
from slotlake.llm import byte_bpe, queries, token_shards

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_parts_of_a_long_text_give_the_ids_of_the_whole():
    enc = byte_bpe.encoding(RANKS, P.PATTERN)
    for text in ["It's 12 o'clock.\n  He'll go \t on 漢字 'S", "\n" * 9000 + "x", " " * 9000, "a  " * 5000, "x\x1c \x85 y" * 3000]:
        assert [i for p in byte_bpe.parts(text, 7) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
        assert byte_bpe.encode_text(enc, text) == enc.encode_ordinary(text)


def test_ids_and_bytes(spark):
    docs = B.awkward(spark)
    coded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN, keep=("source",)), RANKS, P.PATTERN)
    got = [(r.doc_id, r.source, tuple(r.ids), bytes(r.decoded)) for r in coded.collect()]
    ids = B.rank_ids([t for _, t, _ in B.AWKWARD])
    assert B.counted(got) == B.counted((d, s, tuple(i), (t or "").encode()) for (d, t, s), i in zip(B.AWKWARD, ids))


def test_no_texts(spark):
    none = B.awkward(spark).limit(0)
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0


def test_byte_bpe_query(spark, docs_dir, doc_rows):
    want = [(d, len(i), B.sha(",".join(map(str, i))), B.sha(t or "")) for (d, t, _), i in zip(doc_rows, B.rank_ids([r[1] for r in doc_rows]))]
    assert B.counted(queries.QUERIES["op1_byte_bpe"](spark, docs_dir).collect()) == B.counted(want)


def shard_rows(texts):
    ids = token_shards.encode_texts(P.path("word_bpe_49k.json"), texts)
    return ids, token_shards.shard(0, 0, list(range(len(ids))), ids, 49408)


def test_word_ids_are_the_librarys():
    texts = [t or "" for _, t, _ in B.AWKWARD] + ["a.b. c, d! It's <|endoftext|> Σας. ΑΣ, é. \"quoted\" ́x"]
    assert [list(map(int, i)) for i in token_shards.encode_texts(P.path("word_bpe_49k.json"), texts)] == B.word_ids(texts)


def test_letters_before_a_mark_and_added_tokens():
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha()]
    texts = [" ".join(f"{c}. x{c}!" for c in letters[i:i + 500]) for i in range(0, len(letters), 500)]
    texts += ["İ.", "क़, ড়!", "x <|endoftext|> y", "a<|endoftext|>b <|startoftext|>.", "<|ENDOFTEXT|>", "<|endoftext|>" * 3, "| <| endoftext |>"]
    assert [list(map(int, i)) for i in token_shards.encode_texts(P.path("word_bpe_49k.json"), texts)] == B.word_ids(texts)


def test_letters_in_lower_case_are_looked_up_once():
    path = P.path("word_bpe_49k.json")
    known = token_shards._memory(path)
    known.clear()
    known[""] = b""
    texts = ["Garden garden GARDEN Garden, garden!? GARDEN&&&", "Éclair éclair ÉCLAIR. it's a1 A1"]
    assert [list(map(int, i)) for i in token_shards.encode_texts(path, texts)] == B.word_ids(texts)
    assert set(known) == {"", "garden", "éclair", ",", "!?", "&&&", ".", "it's", "a1", "A1"}


def test_letters_and_marks_are_parted_as_by_the_library():
    letters, marks = [chr(c) for c in range(65, 0x250) if chr(c).isalpha()], token_shards.MARKS
    assert set(token_shards.LETTERS) <= set(letters)
    tails = [*marks, *[a + b for a in marks for b in marks], "'s", "'s.", ".'s", "…", "×", "÷.", "\u0301.", "\u0331", "1.", ".1", ".a", "\u00a0."]
    texts = [" ".join(f"{c}{t} x{c.upper()}{t} {c}H{t}" for t in tails) for c in letters]
    texts += [" ".join(f"{t}{c}" for t in tails) for c in letters] + [" ".join(tails)]
    texts += ["<|endoftext|>. x<|endoftext|>! <|ENDOFTEXT|> <|startoftext|>&&&"]
    assert [list(map(int, i)) for i in token_shards.encode_texts(P.path("word_bpe_49k.json"), texts)] == B.word_ids(texts)


def test_parts_ascend_and_spread_repeated_ids():
    bounds, checks = B.np.array([5, 9, 9, 9, 20]), B.np.array([0, 1 << 31, (1 << 32) - 1], B.np.int64)
    parts = lambda d: token_shards.parts_of(token_shards.pa.array([d] * 3, token_shards.pa.int64()), checks, bounds).tolist()
    assert [parts(d) for d in (-2**63, 5, 6, 9, 10, 2**63 - 1)] == [[0] * 3, [0, 1, 1], [1] * 3, [1, 3, 4], [4] * 3, [5] * 3]
    assert parts(None) == [6, 9, 11]


def test_large_ids_ascend(spark, tmp_path):
    ids = [2**60, 2**60 + 5, 2**60 + 1, -2**62, 2**63 - 1, 2**53 + 1, 2**53, -2**63] * 2
    docs = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string").repartition(4)
    token_shards.write(docs, P.path("word_bpe_49k.json"), str(tmp_path / "large"))
    got = sorted(token_shards.read(spark, str(tmp_path / "large")).select("start", "doc_id").collect())
    assert [r.doc_id for r in got] == sorted(ids)


def test_shards_decode_whole_and_at_any_place():
    texts = ["the cat sat on the mat " * 40, "", "the cat sat", "\"quoted\" \" \"" * 9] * 5
    ids, row = shard_rows(texts)
    assert len(row["sequence"]) < sum(4 * len(i) for i in ids)
    assert token_shards.texts_of(row).column("ids").to_pylist() == [i.tobytes() for i in ids]
    assert all(list(token_shards.text_at(row, k)) == list(i) for k, i in enumerate(ids))
    flat = [x for i in ids for x in i]
    assert [token_shards.id_at(row, p) for p in range(len(flat))] == flat


def test_a_rule_never_reaches_into_the_next_text():
    ids, row = shard_rows(["a b"] * 50)
    ends = [0, *memoryview(row["ends"]).cast("i")]
    assert len(ends) == 51 and all(b > a for a, b in zip(ends, ends[1:]))


def test_shards_of_awkward_rows(spark, tmp_path):
    path = str(tmp_path / "shards")
    token_shards.write(B.awkward(spark), P.path("word_bpe_49k.json"), path)
    got = sorted(((r.doc_id is None, r.start, r.doc_id, bytes(r.ids)) for r in token_shards.read(spark, path).collect()), key=lambda r: r[1])
    assert [r[2] for r in got] == sorted([d for d, _, _ in B.AWKWARD if d is not None]) + [None, None]
    place = 0
    for _, start, _, ids in got:
        assert start == place
        place += len(ids) // 4
    want = B.counted((d, hashlib.md5(bytes(memoryview(B.np.array(i, "<i4")).cast("B"))).hexdigest()) for (d, _, _), i in zip(B.AWKWARD, B.word_ids([t for _, t, _ in B.AWKWARD])))
    assert B.counted((d, hashlib.md5(ids).hexdigest()) for _, _, d, ids in got) == want


def test_no_shards(spark, tmp_path):
    token_shards.write(B.awkward(spark).limit(0), P.path("word_bpe_49k.json"), str(tmp_path / "none"))
    assert token_shards.read(spark, str(tmp_path / "none")).count() == 0


def test_token_shards_query(spark, docs_dir, doc_rows):
    want, place = [], 0
    rows = sorted(doc_rows)
    for (d, _, _), ids in zip(rows, B.word_ids([r[1] for r in rows])):
        want.append((d, place, len(ids), B.crc(ids)))
        place += len(ids)
    assert B.counted(queries.QUERIES["op8_token_shards"](spark, docs_dir).collect()) == B.counted(want)


def test_broken_rules_are_refused():
    with pytest.raises(ValueError):
        token_shards.rule_lengths(B.np.array([11], B.np.int32), B.np.array([3], B.np.int32), 10)
