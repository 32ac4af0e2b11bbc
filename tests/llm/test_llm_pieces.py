import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as formats

import llm_brute as B
from slotlake.llm import queries, sentence_pieces

MODEL = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = ["", " ", "  a  b ", "▁", " ▁ x ▁▁  y", "a▁b", "\x00\t\r\n x", "é漢😀 İ", "<s> <unk> <0x41>", "1234 " * 30,
         "word " * 400, " " * 50 + "x" + " " * 50, "漢字" * 90, "a b " * 300 + "▁ c"]


def proto_bounds(text):
    """Begin of every piece and the end of the last, as the library tells them."""
    pieces = LIBRARY.encode(text, return_type="proto").pieces
    return [p.begin for p in pieces] + [pieces[-1].end if pieces else 0]


def check(text, size):
    ids, bounds = sentence_pieces.model(MODEL).encode(text, size)
    want = LIBRARY.encode(text)
    assert ids.tolist() == want
    data = text.encode()
    if want:
        assert bounds[0] == 0 and bounds[-1] == len(data)
    for i, (mine, theirs) in enumerate(zip(bounds.tolist(), proto_bounds(text))):
        if i == len(want) or not LIBRARY.is_byte(want[i]):
            assert mine == theirs
        else:
            assert data[mine] == want[i] - LIBRARY.piece_to_id("<0x00>")


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_ids_and_bounds_are_the_librarys(size):
    for text in [*TEXTS, *[t or "" for _, t, _ in B.AWKWARD]]:
        check(text, size)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" ▁ab\n1é漢😀İ́the")), max_size=40), st.integers(1, 9))
def test_parts_give_the_ids_of_the_whole(text, size):
    check(text, size)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_compiled_maps_normalise_as_the_library_does(rule, squeeze, dummy):
    spec = formats.NormalizerSpec.FromString(
        sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces = squeeze, dummy, True
    theirs = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=dummy, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    mine = sentence_pieces.Normaliser(spec)
    for text in [*TEXTS, "ﬁ①  ㌔ x　y Å", "Å ＡＢＣ", "क़ ｶﾞ", "﻿x​y", "Straße İ", "ǅ" * 20, "   "]:
        normal, starts = mine(text.encode())
        want, offsets = theirs.normalize(text, with_offsets=True)
        assert normal.decode() == want, (rule, text)
        # the library counts characters; compare at the characters of the normal form
        ends = [0]
        for c in want:
            ends.append(ends[-1] + len(c.encode()))
        assert [len(text.encode()[:starts[e]].decode()) for e in ends] == offsets, (rule, text)


def test_rows(spark):
    coded = sentence_pieces.decode(sentence_pieces.encode(B.awkward(spark), MODEL), MODEL)
    got = [(r.doc_id, tuple(r.ids), r.decoded) for r in coded.collect()]
    ids = [LIBRARY.encode(t or "") for _, t, _ in B.AWKWARD]
    assert B.counted(got) == B.counted((d, tuple(i), LIBRARY.decode(i)) for (d, _, _), i in zip(B.AWKWARD, ids))
    assert sentence_pieces.decode(sentence_pieces.encode(B.awkward(spark).limit(0), MODEL), MODEL).count() == 0
    assert sentence_pieces.decode(spark.sql("SELECT 1 AS doc_id, cast(null AS array<int>) AS ids"), MODEL).first().decoded == ""


def test_places_cut_the_source_into_pieces(spark):
    text = "naïve 漢字  café"
    rows = sentence_pieces.places(sentence_pieces.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL)).collect()
    assert b"".join(text.encode()[r.begin:r.end] for r in sorted(rows, key=lambda r: r.place)) == text.encode()


def test_query(spark, docs_dir, doc_rows):
    want = []
    for d, t, _ in doc_rows:
        ids = LIBRARY.encode(t or "")
        want.append((d, len(ids), B.sha(",".join(map(str, ids))), B.sha(LIBRARY.decode(ids)), len((t or "").encode())))
    assert B.counted(queries.QUERIES["op11_sentence_pieces"](spark, docs_dir).collect()) == B.counted(want)
