import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import files, tokens
from scorelake.llm.queries import folder_for
from tests.llm.edges import ROWS, edge_docs, no_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400), st.integers(0, 200))
def test_blocks_round_trip(ids, zeros):
    ids = np.array(ids[:200] + [0] * zeros + ids[200:], np.uint64)
    assert (tokens.unpack(tokens.pack(ids), len(ids)) == ids).all()


def test_known_words():
    assert tokens.pack(np.array([5, 6, 7], np.uint64)).tolist()[0] >> 60 == 4  # twenty of three bits, padded
    assert tokens.pack(np.zeros(120, np.uint64)).tolist() == [1 << 60]
    assert tokens.pack(np.array([2**63], np.uint64)).tolist() == [0, 2**63]


def test_encoder_equals_the_library():
    tool, rng = tokens.Encoder(PATH), np.random.default_rng(3)
    signs = list(" \n\t'abcséñ1２½.,!　‍\x1c\x85日😀")
    texts = ["".join(rng.choice(signs, size=rng.integers(0, 50))) for _ in range(1500)] + [r[1] for r in ROWS if r[1]] + ["a<|endoftext|>b", " lead", "trail ", "it's  ' s"]
    assert [x.tolist() for x in tool.encode(texts)] == [e.ids for e in tool.library.encode_batch(texts, add_special_tokens=False)]
    tool.LIMIT = 10  # forgets its words between batches
    assert [x.tolist() for t in texts[:50] for x in tool.encode([t])] == [e.ids for e in tool.library.encode_batch(texts[:50], add_special_tokens=False)]


@pytest.mark.parametrize("file_ids", [7, 1 << 26])
def test_files_round_trip(spark, file_ids):
    tool, folder = tokens.Encoder(PATH), folder_for(spark, "test-ids")
    written = tokens.write_token_files(edge_docs(spark), folder, PATH, partitions=3, file_ids=file_ids).collect()
    got = tokens.read_token_digests(spark, folder).collect()
    want = {}
    for doc_id, text, *_ in ROWS:
        ids = [*tool.library.encode(text or "", add_special_tokens=False).ids, 0]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(k), *v) for k, vs in want.items() for v in vs)
    start = 0
    for r in sorted(got, key=lambda r: (r["start"])):
        assert r["start"] == start
        start += r["n_tokens"]
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert in_order == sorted(in_order, key=lambda x: (x is not None, x or 0))
    assert sum(r["n_ids"] for r in written) == start


def test_slices(spark):
    folder = folder_for(spark, "test-ids")
    path = max(tokens.write_token_files(edge_docs(spark), folder, PATH, partitions=1).collect(), key=lambda r: r["n_ids"])["path"]
    reader = tokens.Reader(*files.opened(path))
    whole = np.concatenate([reader.block(k) for k in range(len(reader.blocks))])
    assert len(reader.blocks) > 2
    for a, b in ((0, 5), (65_530, 65_545), (reader.ids - 3, reader.ids + 9), (10, 10), (0, reader.ids)):
        assert (reader.slice(a, b) == whole[a:b]).all()


def test_empty(spark):
    folder = folder_for(spark, "test-ids")
    assert tokens.write_token_files(no_docs(spark), folder, PATH).collect() == []
    assert tokens.read_token_digests(spark, folder).collect() == []
