import hashlib
from collections import Counter
from dataclasses import replace

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemill.llm import alignment
from tidemill.llm.queries import QUERIES, align_settings


@pytest.fixture(scope="module")
def streams():
    a_tool = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def both(text):
        if not text:
            return [], []
        a = a_tool.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(spelled[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        b = []
        for i in b_tool.encode(text):
            piece = b_tool.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_tool.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    return both


def brute(rows, both):
    details, counts = [], Counter()
    for doc_id, text in rows:
        a, b = both(text)
        spans = []
        for stream in (a, b):
            at, out = 0, []
            for i, data in stream:
                out.append((i, at, at + len(data)))
                at += len(data)
            spans.append(out)
        links, j = [], 0
        for i, x, y in spans[0]:
            while j < len(spans[1]) and spans[1][j][2] <= x:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < y:
                links.append((i, spans[1][k][0]))
                k += 1
        common = {s[2] for s in spans[0]} & {s[2] for s in spans[1]}
        split = []
        for stream in spans:
            parts = [[]]
            for i, _, y in stream:
                parts[-1].append(str(i))
                if y in common:
                    parts.append([])
            split.append([",".join(p) for p in parts[:-1]])
        groups = [f"{x}|{y}" for x, y in zip(*split)]
        counts.update(links)
        details.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return [
        (d, n_a, n_b, g, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha)
        for d, n_a, n_b, g, links, sha in details
    ]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def scored(docs, settings):
    aligned = alignment.align(docs, "doc_id", "text", settings)
    return alignment.score(aligned, alignment.link_counts(aligned, settings), settings)


def test_query_against_brute_force(spark, sf, documents, streams):
    got = rows_of(QUERIES["op12_token_alignment"](spark, sf))
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in documents.collect()], streams), key=str)


def test_odd_rows_in_tiny_ranges(spark, odd, empty, streams):
    extra = [
        (20, "a▁b", "en", "a"), (21, "<|endoftext|> and </s> <0x41>", "en", "a"), (22, "  two  blanks \n\n and　wide ", "en", "a"),
        (23, "x" * 300 + "漢字仮名" * 20, "en", "a"), (24, " ", "en", "a"), (25, "end. ", "en", "a"),
    ]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string").select("doc_id", "text"))
    want = sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()], streams), key=str)
    # ranges of a few bytes: tokens reach across them; hardly any pair is looked up, the others are joined
    tiny = replace(align_settings(), chunk_bytes=5, fan=3, frequent=8, batch_bytes=200, flush=16)
    small = docs.filter("doc_id IS NULL OR doc_id <> 5")
    assert rows_of(scored(small, tiny)) == sorted(brute([(r["doc_id"], r["text"]) for r in small.collect()], streams), key=str)
    assert rows_of(scored(docs, replace(align_settings(), chunk_bytes=50_000, frequent=64))) == want
    assert rows_of(scored(empty, align_settings())) == []


def test_joining_fragments_is_associative():
    random = np.random.default_rng(5)
    for _ in range(200):
        size = 40
        streams = []
        for _ in range(2):
            ends = np.append(np.flatnonzero(random.random(size - 1) < random.choice([0.2, 0.6])) + 1, size)
            streams.append(np.column_stack((random.integers(0, 99, len(ends)), ends)))
        whole = alignment.Fragment.of(*streams, alignment.MOST_IDS)
        marks = sorted({0, size, *random.integers(0, size, 3).tolist()})
        parts = [alignment.Fragment.of(*(s[(s[:, 1] > x) & (s[:, 1] <= y)] for s in streams), alignment.MOST_IDS) for x, y in zip(marks, marks[1:])]
        left = parts[0]
        for p in parts[1:]:
            left = left + p
        right = parts[-1]
        for p in reversed(parts[:-1]):
            right = p + right
        for joined in (left, right):
            for name in ("cut", "groups", "n_groups", "links"):
                assert getattr(joined, name) == getattr(whole, name)
            for name in ("pre_a", "pre_b", "suf_a", "suf_b"):
                assert np.array_equal(getattr(joined, name), getattr(whole, name))
