import math
from collections import Counter

import pyarrow as pa
import pytest

from tidemill.llm import scoring
from tidemill.llm.queries import QUERIES


def brute(rows, targets, d=0.5):
    def grams(text):
        own = [256, 256, *(text or "").encode()]
        return [tuple(own[i : i + 3]) for i in range(len(own) - 2)]

    def model(texts):
        seen = [Counter(), Counter(), Counter()]
        for text in texts:
            for g in grams(text):
                for n in range(3):
                    seen[n][g[2 - n :]] += 1

        def p(g):
            out = 1 / 256
            for n in range(3):
                own = {k: v for k, v in seen[n].items() if k[:-1] == g[2 - n : 2]}
                if own:
                    size = sum(own.values())
                    out = max(own.get(g[2 - n :], 0) - d, 0) / size + d * len(own) / size * out
            return out

        return p

    ours = model([t for i, t in rows if i in targets])
    theirs = model([t for i, t in rows if i not in targets])
    out = {}
    for i, t in rows:
        g = grams(t)
        losses = [-sum(math.log2(p(x)) for x in g) / len(g) if g else None for p in (ours, theirs)]
        out[i] = (len(g), *losses)
    return out


def test_against_brute_force(spark):
    rows = [(1, "abracadabra"), (2, "abba é"), (3, None), (4, ""), (5, "cab cab cab"), (6, "zzz")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, target string, n string")
    marks = spark.createDataFrame([(1,), (5,), (5,), (None,)], "doc_id long")
    got = scoring.score(df, "doc_id", "text", marks, "doc_id").collect()
    want = brute(rows, {1, 5})
    assert len(got) == len(rows)
    for r in got:
        n, ours, theirs = want[r["doc_id"]]
        assert r["n_tokens"] == n
        if n:
            assert r["target_loss"] == pytest.approx(ours, rel=1e-5)
            assert r["background_loss"] == pytest.approx(theirs, rel=1e-5)
            assert r["score"] == pytest.approx(r["target_loss"] - r["background_loss"])
        else:
            assert r["target_loss"] is None and r["score"] is None


def test_pieces_do_not_matter(monkeypatch):
    data = "ein längerer Text".encode() * 10
    whole = [g for part in scoring.trigrams(data) for g in part.tolist()]
    monkeypatch.setattr(scoring, "PIECE", 5)
    assert [g for part in scoring.trigrams(data) for g in part.tolist()] == whole


def test_good_documents_score_lower(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = scoring.score(documents, "doc_id", "text", labels.filter("quality = 1"), "doc_id").join(labels, "doc_id")
    means = {r["quality"]: r["m"] for r in scored.groupBy("quality").agg({"score": "mean"}).withColumnRenamed("avg(score)", "m").collect()}
    assert means[1] < means[0]


def test_odd_rows(spark, odd, empty):
    marks = spark.createDataFrame([(6,)], "doc_id long")
    got = scoring.score(odd, "doc_id", "text", marks, "doc_id").collect()
    assert len(got) == odd.count()
    assert scoring.score(empty, "doc_id", "text", marks, "doc_id").count() == 0
    none = scoring.score(odd, "doc_id", "text", marks.limit(0), "doc_id").filter("n_tokens > 0").collect()
    assert all(r["target_loss"] == pytest.approx(8.0) for r in none)


def brute_words(rows, targets, order, d=0.5):
    def grams(text):
        own = [None] * (order - 1) + (text or "").split()
        return [tuple(own[i : i + order]) for i in range(len(own) - order + 1)]

    words = {w for _, t in rows for w in (t or "").split()}

    def model(texts):
        seen = [Counter(g[order - n :] for t in texts for g in grams(t)) for n in range(1, order + 1)]

        def p(g):
            out = 1 / len(words)
            for n in range(1, order + 1):
                own = {k: v for k, v in seen[n - 1].items() if k[:-1] == g[order - n : -1]}
                if own:
                    size = sum(own.values())
                    out = max(own.get(g[order - n :], 0) - d, 0) / size + d * len(own) / size * out
            return out

        return p

    models = [model([t for i, t in rows if (i in targets) == mine]) for mine in (True, False)]
    return {i: [-sum(math.log2(p(x)) for x in grams(t)) / len(grams(t)) if grams(t) else None for p in models] for i, t in rows}


@pytest.mark.parametrize(("order", "frequent"), [(1, 4), (2, 1 << 20), (2, 1), (2, 8), (3, 8)])
def test_words_against_brute_force(spark, order, frequent):
    rows = [(1, "a b a b c é"), (2, "b a b a"), (3, None), (4, " \n"), (5, "a b c\ta"), (6, "zz a b"), (7, "b a b a"), (8, "zz")]
    df = spark.createDataFrame([*rows, (7, "b a b a")], "doc_id long, text string").selectExpr("*", "'x' AS target", "'y' AS n", "'z' AS g")
    marks = spark.createDataFrame([(1,), (5,), (5,), (None,)], "doc_id long")
    settings = scoring.LmSettings(order=order, frequent=frequent)
    got = scoring.score_words(df, "doc_id", "text", marks, "doc_id", settings).collect()
    want = brute_words([*rows, (7, "b a b a")], {1, 5}, order)
    assert len(got) == len(rows) + 1
    for r in got:
        assert r["n_tokens"] == len((dict(rows)[r["doc_id"]] or "").split())
        if r["n_tokens"]:
            assert [r["target_loss"], r["background_loss"]] == pytest.approx(want[r["doc_id"]])
            assert r["score"] == pytest.approx(r["target_loss"] - r["background_loss"])
        else:
            assert r["target_loss"] is None and r["score"] is None


def test_query_tells_word_order_apart(spark, tmp_path):
    """Both kinds have the same words, most with the same letters at their ends; only their order differs."""
    words = [f"a{i}bcdefghijklmnop{i}z" for i in range(12)]
    text = lambda i, step: " ".join(words[(i + k * step) % 12] for k in range(40))
    rows = [(i, text(i, 5 if i % 2 else 7)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op10_lm_scoring"](spark, str(tmp_path)).collect()}
    assert all(got[i]["n_tokens"] == 40 for i in got)
    # held-out odd documents look like the target by bits a word, even ones like the background
    assert max(got[i]["score"] for i in range(41, 60, 2)) < -0.5 < 0.5 < min(got[i]["score"] for i in range(40, 60, 2))


def test_words_of_odd_rows(spark, odd, empty):
    marks = spark.createDataFrame([(6,)], "doc_id long")
    assert len(scoring.score_words(odd, "doc_id", "text", marks, "doc_id").collect()) == odd.count()
    assert scoring.score_words(empty, "doc_id", "text", marks, "doc_id").count() == 0


def test_word_tables_lie_on_disk_part_by_part(spark, monkeypatch):
    """Never all n-grams of the corpus at a time, and nothing but the result in the end."""
    rows = [(i, " ".join(f"w{i * k % 97}" for k in range(1, 60))) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = {pair for _, t in rows for pair in zip(["", *t.split()], t.split())}
    held, most, write, delete = {}, [0], scoring.materialize, scoring.release

    def written(table, label):
        out = write(table, label)
        held[out.written_path] = 0 if label in ("lm-rows", "lm-scores") else out.count()
        most[0] = max(most[0], sum(held.values()))
        return out

    def released(*tables):
        for table in tables:
            held.pop(table.written_path)
        delete(*tables)

    monkeypatch.setattr(scoring, "materialize", written)
    monkeypatch.setattr(scoring, "numbered", lambda t, label: written(t.selectExpr("*", "monotonically_increasing_id() AS _row"), label))
    monkeypatch.setattr(scoring, "release", released, raising=False)
    got = scoring.score_words(df, "doc_id", "text", spark.createDataFrame([(1,)], "doc_id long"), "doc_id")
    want = brute_words(rows, {1}, 2)
    assert all([r["target_loss"], r["background_loss"]] == pytest.approx(want[r["doc_id"]]) for r in got.collect())
    assert most[0] < len(pairs) and len(held) == 1


def test_word_codes_are_of_whole_words():
    texts = [" a  b\x0bc ", "", None, "\n", "x\x1cy z", "ab", "cd", "é" * 100 + " " + "q" * 513, "q" * 512, "12345678", "123456789 12345678 a"]
    words = [(t or "").encode().split() for t in texts]
    for array in (pa.array(texts), pa.array(["z", *texts]).slice(1), pa.array(texts, pa.large_string())):
        codes, counts = scoring.word_codes(array)
        assert counts.tolist() == [len(w) for w in words]
        flat = [w for own in words for w in own]
        assert len(set(zip(flat, codes.tolist()))) == len(set(flat)) == len(set(codes.tolist()))
