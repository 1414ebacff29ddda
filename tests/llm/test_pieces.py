import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from scorelake.llm import pieces
from tests.llm.edges import ROWS, edge_docs, no_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = list("  \n\t'abcséñ1２½.,!▁\x1c\x85日😀the\x00")


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(PATH)


def random_texts(n, signs=SIGNS, seed=5):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(signs, size=rng.integers(0, 50))) for _ in range(n)]


def test_ids_equal_the_library(codec):
    texts = random_texts(1500) + [r[1] or "" for r in ROWS] + ["", " ", "  a", "a  b ", "▁", "a▁b"]
    assert [x.tolist() for x in codec.ids(texts)] == codec.library.encode(texts)
    assert codec.decode(codec.ids(texts)) == codec.library.decode(codec.library.encode(texts))


def test_spans(codec):
    for text in random_texts(800, seed=6):
        ids = codec.ids([text])[0]
        spans, data = codec.spans(text, ids), text.encode()
        proto = codec.library.encode(text, return_type="proto")
        assert len(spans) == len(proto.pieces) and (not len(ids) or (spans[0, 0] == 0 and spans[-1, 1] == len(data)))
        assert (spans[1:, 0] == spans[:-1, 1]).all()
        for (a, b), p in zip(spans.tolist(), proto.pieces, strict=True):
            if not codec.library.is_byte(p.id):  # the library gives a sign's bytes to the last of its byte pieces
                assert (a, b) == (p.begin, p.end)
            else:
                assert b - a == 1


def test_a_shifted_alignment_is_seen(codec):
    for text in random_texts(300, seed=8) + ["the cat sat on 日本", " two  spaces "]:
        ids = codec.ids([text])[0]
        spans = codec.spans(text, ids)
        assert codec.aligned(text, ids, spans)
        inner = [k for k in range(len(ids) - 1) if spans[k + 1, 1] > spans[k + 1, 0] and not codec.is_byte[ids[k:k + 2]].any()]
        for k in inner[:3]:  # one sign moved from a piece to its neighbour
            moved = spans.copy()
            moved[k, 1] += 1
            moved[k + 1, 0] += 1
            assert not codec.aligned(text, ids, moved)
        if len(ids) > 1:
            assert not codec.aligned(text, ids[::-1], spans) or (ids == ids[::-1]).all()
            assert not codec.aligned(text, ids, spans[:-1]) if spans[-1, 0] < spans[-1, 1] else True


def test_compiled_map_normalises_like_the_library():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    spec = model.normalizer_spec
    own = pieces.Normaliser(pieces.Spec(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, False, False, (), False))
    for text in random_texts(1500, SIGNS + list("ÅÅﬁ①㍿ｶﾞ각​﻿ 　"), 7):
        made = own(text)
        assert made.text.decode() == library.normalize(text)
        assert len(made.source) == len(made.text) + 1 and (np.diff(made.source) >= 0).all() and made.source[-1] <= len(text.encode())
    made = own("x ﬁ")  # the ligature's two letters come from its three bytes
    assert made.text.decode() == "▁x▁fi" and made.source.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 5]


def test_rows(spark, codec):
    got = pieces.encoded(edge_docs(spark), PATH).collect()
    assert len(got) == len(ROWS) and all(r["aligned"] for r in got)
    want = []
    for doc_id, text, *_ in ROWS:
        ids = codec.library.encode(text or "")
        want.append((str(doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert all(len(r["ids"]) == len(r["starts"]) == len(r["ends"]) == r["n_tokens"] for r in got)
    assert pieces.encoded(no_docs(spark), PATH).collect() == []
