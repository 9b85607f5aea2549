import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import bytelevel, tokens
from tidemill.llm.queries import QUERIES, token_settings

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def expected(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_tokenizer(spark, sf, documents):
    rows = [tuple(r) for r in QUERIES["op5_token_ids"](spark, sf).collect()]
    assert sorted(rows) == expected([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_rows_round_trip(spark, odd, empty, folder):
    small = tokens.TokenSettings(tokenizer=PATH, block_tokens=50, interval=7)
    tokens.write_tokens(odd, "doc_id", "text", folder, small)
    rows = tokens.read_tokens(spark, folder, with_ids=True).collect()
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=str)
    assert got == sorted(expected([(r["doc_id"], r["text"]) for r in odd.collect()]), key=str)
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert all(r["ids"] == plain(texts[r["doc_id"]]) for r in rows if r["doc_id"] != 5)
    tokens.write_tokens(empty, "doc_id", "text", folder + "-empty", small)
    assert tokens.read_tokens(spark, folder + "-empty").count() == 0


TEXTS = st.text(st.sampled_from(" \n\tabst.,'é漢1<|>\x1c　") | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS | st.just("x <|endoftext|> y"), max_size=8))
def test_pieces_equal_whole_texts(texts):
    import pyarrow as pa

    ids, counts = bytelevel.encode_texts(pa.array(texts, pa.string()), PATH, True, 1000)
    assert bytelevel.byte_level(PATH, True).splits
    want = [Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=300), st.integers(4, 12), st.integers(1, 40))
def test_huffman_round_trip_and_limit(counts, limit, interval):
    code = tokens.make_code(list(enumerate(counts)), limit)
    assert code.width <= max(limit, int(np.ceil(np.log2(len(counts)))), 1)
    if len(counts) > 1:
        assert sum(2.0 ** -int(n) for n in code.lengths) == 1.0
    own = np.random.default_rng(len(counts)).integers(0, len(counts), 500)
    data = tokens.encode_block([3, 4], np.array([200, 300]), own, code, code.words(), np.arange(len(counts)), interval)
    ids, sizes, back, end = tokens.decode_block(memoryview(data), 0, code.table(), code.width)
    assert ids.tolist() == [3, 4] and sizes.tolist() == [200, 300] and end == len(data)
    assert (back == own).all()


def test_unlimited_lengths_are_optimal():
    import heapq

    counts = [int(1.7**k) + 1 for k in range(20)]
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    lengths = tokens.code_lengths(np.array(counts), 30)
    assert int((lengths * np.array(counts)).sum()) == total


def test_damage_is_noticed():
    code = tokens.make_code([(0, 5), (7, 3)], 4)
    data = bytearray(tokens.encode_block([1], np.array([4]), np.array([0, 7, 7, 0]), code, code.words(), np.array([0] * 7 + [1]), 2))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        tokens.decode_block(memoryview(bytes(data)), 0, code.table(), code.width)


def test_settings_name_the_public_file():
    assert token_settings().tokenizer == PATH
