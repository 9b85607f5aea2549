import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import sentencepieces
from tidemill.llm.queries import QUERIES, piece_settings

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_the_library(spark, sf, documents, library):
    rows = sorted(tuple(r) for r in QUERIES["op11_sentencepiece"](spark, sf).collect())
    expected = []
    for r in documents.collect():
        ids = library.encode(r["text"] or "")
        expected.append((r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert rows == sorted(expected)


def test_odd_rows(spark, odd, empty, library):
    s = sentencepieces.PieceSettings(model=PATH, batch_bytes=100, remembered=5)
    rows = sentencepieces.decode(sentencepieces.encode(odd, "doc_id", "text", s), s).collect()
    wanted = [(r["doc_id"], library.encode(r["text"] or "")) for r in odd.collect()]
    assert sorted([(r["doc_id"], list(r["ids"])) for r in rows], key=str) == sorted(wanted, key=str)
    assert sorted([r["text"] for r in rows]) == sorted(library.decode(ids) for _, ids in wanted)
    assert sentencepieces.decode(sentencepieces.encode(empty, "doc_id", "text", s), s).count() == 0


TEXTS = st.text(st.sampled_from("  ▁▁aabeinths\n.1é漢\U0001f600") | st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=8))
def test_any_text(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids, sizes = sentencepieces.encode_texts(pa.array(texts, pa.string()), PATH, 1000)
    want = [library.encode(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert sentencepieces.pieces(PATH).decode(ids.astype(np.int64), sizes).to_pylist() == library.decode(want)


def test_long_runs_and_repeats(library):
    texts = [" " * k + "x" + " " * k for k in range(70)] + ["a" * 5000, "ab" * 3000, "the" * 2000, " " * 50_000, "漢字" * 500]
    ids, sizes = sentencepieces.encode_texts(pa.array(texts), PATH, 1000)
    want = [library.encode(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_decode_any_ids(library):
    random.seed(3)
    kinds = [lambda: random.randrange(32000), lambda: random.randrange(262), lambda: random.choice([0, 1, 2, 259, 260])]
    lists = [[random.choice(kinds)() for _ in range(random.randint(0, 12))] for _ in range(3000)]
    flat = np.array([i for ids in lists for i in ids])
    for part in (lists, [x for x in lists if not {1, 2} & set(x)]):
        flat = np.array([i for ids in part for i in ids])
        assert sentencepieces.pieces(PATH).decode(flat, np.array([len(x) for x in part])).to_pylist() == library.decode(part)


def test_a_merge_that_makes_a_better_pair_comes_first():
    """Hand-made vocabulary where merging all equal pairs at once would be wrong."""
    made = sentencepieces.Pieces.__new__(sentencepieces.Pieces)
    made.names = [*"abc", "ab", "aba", "abab", "bc"]
    made.kinds = np.full(len(made.names), sentencepieces.NORMAL)
    made._merges(np.array([0.0, 0, 0, -5, -1, -9, -2]))

    def one_by_one(word):
        parts = list(word)
        score = dict(zip(made.names, [0, 0, 0, -5, -1, -9, -2]))
        while True:
            pairs = [(-score[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in score]
            if not pairs:
                return [made.names.index(p) for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    random.seed(4)
    words = ["".join(random.choice("abc") for _ in range(random.randint(1, 14))) for _ in range(500)]
    ids, sizes = made.encode(words)
    want = [one_by_one(w) for w in words]
    assert ids.tolist() == [i for w in want for i in w]
    assert sizes.tolist() == [len(w) for w in want]
