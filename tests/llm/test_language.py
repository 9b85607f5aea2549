import zlib

from tidemill.llm import language
from tidemill.llm.queries import QUERIES


def test_held_out_accuracy_and_bounds(spark, sf, documents):
    rows = QUERIES["op1_language_id"](spark, sf).collect()
    truth = {r["doc_id"]: r for r in documents.collect()}
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"] and any(c.isalpha() for c in truth[r["doc_id"]]["text"] or "")]
    right = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in tested)
    assert tested and right >= 0.97 * len(tested)


def test_odd_rows(odd, empty):
    model = language.fit(odd, "text", "lang", "doc_id")
    rows = language.predict(odd, "text", model, [odd["doc_id"]]).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert by[5]["lang_pred"] == "de" and by[6]["lang_pred"] == "en"
    nothing = language.fit(empty, "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in language.predict(odd, "text", nothing, [odd["doc_id"]]).collect()} == {"und"}
    assert language.predict(empty, "text", model, [empty["doc_id"]]).count() == 0


def test_grams_do_not_depend_on_the_pieces(monkeypatch):
    text = "Ein längerer Text, mit 12 Zahlen -- und mehr. " * 40
    settings = language.LanguageSettings()
    whole = language.gram_counts(text, settings)
    monkeypatch.setattr(language, "PIECE", 7)
    assert (language.gram_counts(text, settings) == whole).all()


def test_penalty_makes_weights_sparse(documents):
    model = language.fit(documents, "text", "lang", "doc_id")
    assert (model.weights == 0).mean() > 0.3 and model.temperature > 0
