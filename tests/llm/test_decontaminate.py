import math
import re
from collections import Counter

import pytest

from tidemill.llm import decontaminate
from tidemill.llm.queries import QUERIES


def brute(docs, items, size=5, least=0.8):
    def shingles(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]

    own = {i: shingles(t) for i, t in items}
    own = {i: s for i, s in own.items() if s}
    df = Counter(h for s in {(i, tuple(s)) for i, s in own.items()} for h in set(s[1]))
    w = lambda h: math.log1p(len(own) / df.get(h, 1))
    out = {}
    for d, text in docs:
        doc = shingles(text)
        for i, item in own.items():
            known = set(item)
            if len(doc) < len(item) or not known & set(doc):
                continue
            want = Counter(item)
            for at in range(len(doc) - len(item) + 1):
                got = Counter(doc[at : at + len(item)])
                common = sum(w(h) * min(c, want[h]) for h, c in got.items() if h in want)
                union = sum(w(h) * c for h, c in got.items()) + sum(w(h) * c for h, c in want.items()) - common
                if common / union >= least - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), common / union)
    return out


@pytest.mark.parametrize("folder_name", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, folder_name):
    path = f"/root/testdata/{folder_name}"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    items = spark.read.parquet(f"{path}/benchmark.parquet").collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in QUERIES["op3_decontamination"](spark, path).collect()}
    assert got == pytest.approx(want)


def test_altered_passages_and_edges(spark):
    item = " ".join(f"q{i}" for i in range(60))
    changed = item.replace("q30 ", "other ")  # 51 of 61 shingles: 0.836
    far = item.replace("q20 ", "other ").replace("q40 ", "other ")
    docs = [(1, item), (2, "x y " + item.upper().replace("Q", "q") + " z"), (3, "a b c " + changed), (4, far), (5, item[:-20]), (6, None), (7, ""),
            (8, changed + " tail"), (9, "\n".join(item.split())), (9, "unrelated words " * 30), (None, item)]
    items = [(1, item), (2, "too short item"), (3, None), (4, "five words are just enough"), (1, item)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, h int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, item string")
    got = decontaminate.find_leaks(df, "doc_id", "text", bench, "item_id", "text").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (8, 1), (9, 1), (None, 1)}
    by = {r["doc_id"]: r for r in got}
    assert by[1]["similarity"] == pytest.approx(1) and by[2]["first_word"] == 2 and by[2]["n_words"] == 60
    assert by[3]["similarity"] == pytest.approx(brute([(3, docs[2][1])], [(1, item), (4, items[3][1])])[3, 1])


def test_shuffled_joins_agree(spark, sf, documents):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [
        sorted(map(tuple, decontaminate.find_leaks(documents, "doc_id", "text", bench, "item_id", "text", s).collect()))
        for s in (decontaminate.LeakSettings(), decontaminate.LeakSettings(sent_bytes=0))
    ]
    assert rows[0] == rows[1] and rows[0]


def test_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the dog")], "item_id long, text string")
    assert decontaminate.find_leaks(empty, "doc_id", "text", bench, "item_id", "text").count() == 0
    assert decontaminate.find_leaks(odd, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0
    found = decontaminate.find_leaks(odd, "doc_id", "text", bench, "item_id", "text").collect()
    assert {r["doc_id"] for r in found} == {6, 7} and len(found) == 2


def brute_short(docs, items, size=5, least=0.8):
    """Documents shorter than an item against it, each as a whole."""
    own = {i: t.split() for i, t in items}
    grams = {i: [tuple(w[k : k + size]) for k in range(len(w) - size + 1)] for i, w in own.items()}
    df = Counter(h for g in grams.values() for h in set(g))
    weight = lambda c: sum(n * math.log1p(len(items) / df.get(h, 1)) for h, n in c.items())
    out = {}
    for d, text in docs:
        w = text.split()
        doc = Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
        for i, g in grams.items():
            if sum(doc.values()) < len(g):
                similarity = weight(doc & Counter(g)) / weight(doc | Counter(g))
                if similarity >= least - 1e-9:
                    out[d, i] = similarity
    return out


def test_documents_shorter_than_an_item(spark, tmp_path, sf):
    texts = [[f"{name}{i}" for i in range(n)] for name, n in (("oak", 59), ("elm", 80), ("fir", 30))]
    # half of the last item is in all of the others' like: by weight 0.8 is reached with less by count
    common = [f"c{i}" for i in range(24)]
    items = [(k, " ".join(w)) for k, w in enumerate(texts)] + [(10 + k, " ".join([*common, *(f"t{k}x{i}" for i in range(40))])) for k in range(30)]
    docs = [(1, texts[0][:-1]), (2, texts[0][1:]), (3, texts[1][:-10]), (4, texts[1][:-30]), (5, texts[2][2:-1]), (6, texts[2][:20]),
            (7, [f"t3x{i}" for i in range(40)]), (8, texts[0]), (9, [*texts[0][:40], "x", *texts[0][41:58]])]
    docs = [(d, " ".join(w)) for d, w in docs]
    want = brute_short(docs, items)
    assert {d for d, _ in want} == {1, 2, 3, 5, 7, 9}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r for r in QUERIES["op3_decontamination"](spark, str(tmp_path)).collect()}
    assert {k: r["similarity"] for k, r in got.items()} == pytest.approx(want | {(8, 0): 1.0})
    assert got[1, 0]["n_words"] == 58 and got[1, 0]["first_word"] == 0 and got[8, 0]["n_words"] == 59


def test_window_that_begins_with_a_shingle_of_other_sizes(spark):
    item, shared = [f"t{i}" for i in range(60)], [f"p{i}" for i in range(10)]
    items = [(0, " ".join(item))] + [(k, " ".join([*shared, *(f"o{k}x{i}" for i in range(20))])) for k in range(1, 41)]
    docs = [(1, " ".join(["a", "b", *shared[3:], *item[:53], *(f"z{i}" for i in range(30))]))]
    want = brute(docs, items)
    assert set(want) == {(1, 0)}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(df, "doc_id", "text", bench, "item_id", "text").collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == pytest.approx(want)
