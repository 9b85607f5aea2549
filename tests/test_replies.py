import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import fixed, replies
from tidemill.operators import parsing

GOOD = {
    "monetary_stance": "hawkish",
    "trade_stance": "neutral",
    "tariff_mention": 0,
    "economic_outlook": "positive",
}


def column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    return [r["v"] for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def parsed(spark, texts, parse):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    out = parse(df, "reply", "v")
    assert out.columns == ["i", "reply", "v"]
    return [r["v"] for r in out.orderBy("i").collect()]


def test_strip_tokens(spark):
    texts = ["<|return|>text<|end|>", "<|channel|>final<|message|>output", "a < b |> c", ""]
    got = column(spark, texts, replies.strip_tokens("reply"))
    assert got == ["text", "finaloutput", "a < b |> c", ""]


def test_final_channel(spark):
    texts = [
        "<|channel|>analysis<|message|>weighing both sides<|end|>"
        "<|channel|>final<|message|>rates stay put<|return|>",
        "<|channel|> FINAL <|message|> open\nended ",
        "<|channel|>analysis<|message|>one<|end|><|message|>two <|return|>",
        "  plain text ",
        "<|start|>assistant odd <|channel|>",
        "<|channel|>final<|message|>a<|channel|>b<|end|>",
        "<|channel|>final<|message|><|end|>",
    ]
    got = column(spark, texts, replies.final_channel("reply"))
    assert got == ["rates stay put", "open\nended", "two", "plain text", "assistant odd", "ab", ""]


def test_first_json(spark):
    texts = [
        '{"key": "value"}<|return|>',
        'Analysis.<|channel|>final<|message|>{"key": "value"}<|return|>',
        '{"rate": {"policy": "held"}, "votes": [7, 2]} with a stray }',
        '{"note": "a \\"quoted\\" brace {"}',
        '{"note": "Żółć ßüd"}',
        '{"a": 1, "a": 2}',
        "Just plain text",
        '{"key": "value"',
        '{"key": "value",}',
        "{'key': 'value'}",
        "{oops} {\"a\": 1}",
    ]
    got = parsed(spark, texts, parsing.parse_json)
    assert got[0]["fields"] == got[1]["fields"] == {"key": "value"}
    assert got[2]["fields"]["rate"] == '{"policy":"held"}'
    assert json.loads(got[2]["fields"]["votes"]) == [7, 2]
    assert got[3]["fields"] == {"note": 'a "quoted" brace {'}
    assert got[4]["fields"] == {"note": "Żółć ßüd"}
    assert got[5]["fields"] == {"a": "2"}
    assert got[6]["error"] == "No JSON found in response: Just plain text..."
    assert [row["error"] for row in got[7:]] == ["Invalid JSON"] * 4
    assert all(row["error"] is None for row in got[:6])


def strict(spark, *changes):
    texts = [json.dumps({**GOOD, **change}) for change in changes]
    return parsed(spark, texts, parsing.parse_labels)


def test_strict_labels_convert(spark):
    texts = [
        json.dumps(GOOD),
        '<|channel|>final<|message|>{"monetary_stance": "dovish", "trade_stance": "globalist", '
        '"tariff_mention": 1, "economic_outlook": "negative"}<|return|>',
        "Rates.\n" + json.dumps(
            {
                "monetary_stance": "very_hawkish",
                "trade_stance": "very_protectionist",
                "tariff_mention": 1,
                "economic_outlook": "very_negative",
                "extra": [1],
            }
        ),
    ]
    got = [tuple(row) for row in parsed(spark, texts, parsing.parse_labels)]
    assert got == [(4, 3, 0, 4, None), (2, 4, 1, 2, None), (5, 1, 1, 1, None)]


def test_strict_labels_reject(spark):
    got = strict(
        spark,
        {"monetary_stance": "invalid"},
        {"monetary_stance": "somewhat_hawkish"},
        {"monetary_stance": 3},
        {"tariff_mention": "1"},
        {"tariff_mention": True},
        {"tariff_mention": 1.0},
        {"tariff_mention": 2},
        {"economic_outlook": None},
        {"trade_stance": ["neutral"]},
    )
    kinds = [row["error"].removeprefix("Invalid ") for row in got]
    assert kinds == ["monetary_stance"] * 3 + ["tariff_mention"] * 4 + [
        "economic_outlook",
        "trade_stance",
    ]
    assert all(row["monetary_stance"] is None for row in got)


def test_strict_labels_missing_and_broken(spark):
    without = {k: v for k, v in GOOD.items() if k != "trade_stance"}
    texts = [json.dumps(without), json.dumps(GOOD)[:-1], "no object", "{}", '{"tariff_mention": "1"}']
    got = [row["error"] for row in parsed(spark, texts, parsing.parse_labels)]
    assert got == [
        "Invalid trade_stance",
        "Invalid JSON",
        "No JSON found in response: no object...",
        "Invalid monetary_stance",
        "Invalid monetary_stance",
    ]


def test_lenient_labels(spark):
    flags = [0, 1, "0", "1", True, 1.0]
    texts = [json.dumps({**GOOD, "tariff_mention": flag}) for flag in flags]
    texts += [
        json.dumps({**GOOD, "monetary_stance": "somewhat_dovish", "trade_stance": "protectionist"}),
        "text " + json.dumps(GOOD) + " text",
    ]
    got = parsed(spark, texts, parsing.parse_labels_leniently)
    assert [row["tariff_mention"] for row in got] == [0, 1, 0, 1, 1, 1, 0, 0]
    assert got[6]["monetary_stance"] == 2 and got[6]["trade_stance"] == 2
    assert all(row["error"] is None for row in got)


def test_lenient_labels_errors(spark):
    texts = [
        "nothing here",
        "{not json}",
        '{"monetary_stance": "neutral"}',
        json.dumps({**GOOD, "economic_outlook": "sunny"}),
        json.dumps({**GOOD, "tariff_mention": "true"}),
        json.dumps({**GOOD, "tariff_mention": 2}),
        json.dumps({**GOOD, "monetary_stance": None}),
    ]
    got = [row["error"] for row in parsed(spark, texts, parsing.parse_labels_leniently)]
    assert got == [
        "No JSON found in response: nothing here...",
        "Invalid JSON",
        "Missing required fields: ['trade_stance', 'tariff_mention', 'economic_outlook']",
        "Invalid economic_outlook: sunny",
        "Invalid tariff_mention: true",
        "Invalid tariff_mention: 2",
        "Invalid monetary_stance: None",
    ]


@pytest.mark.parametrize("size, kept", [(49, None), (50, 50), (1500, 1500), (1501, 1503)])
def test_summary_check_bounds(spark, size, kept):
    got = column(spark, [" \n" + "s" * size + "\t"], replies.check_summary("reply", 1500))[0]
    if kept is None:
        assert got["summary"] is None and got["error"] == "Summary too short (49 chars)"
    else:
        assert len(got["summary"]) == kept and got["error"] is None
        assert got["summary"].endswith("...") == (size > 1500)


def test_summary_object(spark):
    long = "• point " + "x" * 60
    texts = [
        json.dumps({"reasoning": "r", "summary": " " + long}),
        json.dumps({"summary": " " + long}),
        json.dumps({"reasoning": 5, "summary": [long, "second", "", None, "• third"]}),
        json.dumps({"reasoning": "r", "summary": "y" * 2500}),
        json.dumps({"reasoning": "r", "summary": "short"}),
        json.dumps({"reasoning": "r"}),
        "none",
        json.dumps({"reasoning": "r", "summary": "[1, 2] " + long}),
    ]
    got = parsed(spark, texts, lambda *x: parsing.parse_summary(*x, limit=2000))
    assert got[0]["summary"] == " " + long
    assert got[1]["summary"] == long
    assert got[2]["summary"] == f"{long}\n• second\n• third"
    assert got[3]["summary"] == "y" * 2000
    assert [row["error"] for row in got[4:7]] == [
        "Invalid summary response",
        "Invalid summary response",
        "No JSON found in response: none...",
    ]
    assert got[7]["summary"] == "[1, 2] " + long


def test_error_classes(spark):
    texts = ["Read TIMEOUT 429", "got 429", "rate limit", "502 bad", "port 15003", "weird"]
    got = column(spark, texts, replies.error_class_of_message("reply"))
    assert got == [
        fixed.TIMEOUT,
        fixed.RATE_LIMIT,
        fixed.RATE_LIMIT,
        fixed.SERVER,
        fixed.RETRYABLE,
        fixed.RETRYABLE,
    ]
    df = spark.createDataFrame([(200,), (429,), (500,), (404,), (None,)], "s int")
    classes = [r[0] for r in df.select(replies.error_class_of_status("s", F.lit("timeout"))).collect()]
    assert classes == [None, fixed.RATE_LIMIT, fixed.SERVER, fixed.RETRYABLE, fixed.TIMEOUT]


def test_backoff(spark):
    df = spark.range(10)
    call = [r[0] for r in df.select(replies.call_backoff("id")).collect()]
    assert call == [min(2.0**i, 60.0) for i in range(10)]
    job = [r[0] for r in df.select(replies.job_backoff(F.col("id") + 1, 30.0, 300.0)).collect()]
    assert job[:5] == [30.0, 60.0, 120.0, 240.0, 300.0]
    low, high = (
        [r[0] for r in df.select(replies.call_backoff("id", F.lit(d))).collect()]
        for d in (0.0, 1.0)
    )
    assert low == pytest.approx([c * 0.8 for c in call])
    assert high == pytest.approx([c * 1.2 for c in call])


def test_texts_are_whole_without_a_limit(spark):
    long = "z" * 30_000
    assert column(spark, [long], replies.check_summary("reply"))[0]["summary"] == long
    for shape in ({"reasoning": "r", "summary": long}, {"summary": long}):
        assert parsed(spark, [json.dumps(shape)], parsing.parse_summary)[0]["summary"] == long
