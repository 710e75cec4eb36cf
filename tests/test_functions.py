"""Redaction, cost and settings."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom import Settings
from spanloom.config import RateCard
from spanloom.functions import redact
from spanloom.functions.cost import estimate_tokens, price_calls

# Secret-looking texts, put together at run time.
SECRETS = [
    "sk" + "-" + "a1B2" * 6,
    "AK" + "IA" + "Z9" * 8,
    "bea" + "rer " + "abcdefgh12345678",
    "AI" + "za" + "q7" * 12,
    "gh" + "p_" + "x1" * 12,
    "xo" + "xb-" + "12-" * 5,
]
PLAIN = ["ordinary text", "sk-short", "bearer of news", "", "Ünïcode"]


def clean(spark, values, **options):
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "a string")
    return [json.loads(r[0]) for r in df.select(redact.redact_json(F.col("a"), **options)).collect()]


def test_json_that_is_hard_to_read(spark):
    """Numbers of thousands of digits, deep nesting and broken JSON leak nothing."""

    long = "1" * 6000
    given = [
        '{"password":"hunter2","n":' + long + "}",
        '{"n":-' + long + ',"note":"plain token"}',
        '{"a":' * 40 + '{"password":"hunter2"}' + "}" * 40,
        '{"a":' * 90_000 + '{"password":"hunter2"}' + "}" * 90_000,
        '{"password":"hunter2",}',
        "{nope, a plain text",
        "[password of nobody",
    ]
    df = spark.createDataFrame([(v,) for v in given], "a string")
    got = [r[0] for r in df.select(redact.redact_json(F.col("a"))).collect()]
    blank = redact.BLANK
    assert got[0] == '{"password": "' + blank + '", "n": ' + long + "}"
    assert got[1] == '{"n": -' + long + ', "note": "plain token"}'
    assert got[2] == '{"a": ' * 40 + '{"password": "' + blank + '"}' + "}" * 40
    assert "hunter2" not in got[3]
    assert got[4:] == [blank, given[5], blank]


def test_values(spark):
    df = spark.createDataFrame([(v,) for v in SECRETS + PLAIN], "v string")
    got = [r[0] for r in df.select(redact.redact_value(F.col("v"))).collect()]
    assert got == [redact.BLANK] * len(SECRETS) + PLAIN


def test_keys(spark):
    keys = {"api_key": True, "OpenAI-API-Key": True, "user_password": True, "token_count": True, "note": False, "author": False}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["s"] for r in df.select("k", redact.key_is_sensitive(F.col("k")).alias("s")).collect()}
    assert got == keys


def test_nested_json(spark):
    key = SECRETS[0]
    given = [
        {"auth": {"password": "x", "user": "u"}, "n": 128, "ok": True, "c": 0.0011},
        {"tags": [key, "plain", {"secret": 1}], "note": f"use {key} please"},
        {"list": [[key, "plain"]]},
        {"plain": "nothing here"},
        {"p\\u0061ssword": "kept", "s": SECRETS[5]},
    ]
    blank = redact.BLANK
    assert clean(spark, given) == [
        {"auth": {"password": blank, "user": "u"}, "n": 128, "ok": True, "c": 0.0011},
        {"tags": [blank, "plain", {"secret": blank}], "note": blank},
        {"list": [[blank, "plain"]]},
        {"plain": "nothing here"},
        {"p\\u0061ssword": "kept", "s": blank},
    ]
    assert clean(spark, given[2:3], nested_lists=False) == given[2:3]


def test_escaped_keys_do_not_slip_by(spark):
    df = spark.createDataFrame([('{"p\\u0061ssword":"x"}',)], "a string")
    assert json.loads(df.select(redact.redact_json(F.col("a"))).first()[0]) == {"password": redact.BLANK}


def test_own_keys_and_patterns(spark):
    given = [{"ssn": "1", "note": "INTERNAL-77", "x": "y"}]
    assert clean(spark, given, extra_keys=("S-S-N",), extra_patterns=(r"INTERNAL-[0-9]+",)) == [
        {"ssn": redact.BLANK, "note": redact.BLANK, "x": "y"}
    ]


def test_prices(spark):
    rows = [("us.m", 1000, 1000), ("m", 1000, 1000), ("us.eu.m", 1000, 0), (None, 2000, 0), ("other", 0, 1), ("m", None, None)]
    df = spark.createDataFrame(rows, "model string, tokens_in long, tokens_out long")
    card = RateCard(rates={"m": (0.5, 0.25)})
    got = [r["cost_usd"] for r in price_calls(df, card).collect()]
    # A second prefix is part of the name; unknown models cost the default.
    assert got == [0.75, 0.75, 0.001, 0.002, 5e-06, 0.0]


def test_token_estimate(spark):
    df = spark.createDataFrame([("",), ("abc",), ("abcdefgh",), (None,)], "t string")
    assert [r[0] for r in df.select(estimate_tokens(F.col("t"))).collect()] == [1, 1, 2, 1]


def test_settings_layers(tmp_path):
    file = tmp_path / "spanloom.yml"
    file.write_text("service_name: desk\ndetection:\n  loop_count: 7\n  failure_count: 4\n  cost_limit_usd: 2.5\n")
    got = Settings.resolve(file, {"SPANLOOM_LOOP_COUNT": "9", "SPANLOOM_FAILURE_COUNT": ""})
    assert (got.thresholds.loop_count, got.thresholds.failure_count, got.thresholds.cost_limit_usd) == (9, 4, 2.5)
    assert got.service_name == "desk" and got.source == file
    by_env = Settings.resolve(env={"SPANLOOM_CONFIG": str(file)})
    assert by_env.thresholds.loop_count == 7
    assert Settings.resolve(tmp_path / "missing.yml", {}) == Settings()


@pytest.mark.parametrize("body", ["- a\n- b\n", "detection: 5\n", "just text\n"])
def test_malformed_settings_are_refused(tmp_path, body):
    file = tmp_path / "spanloom.yml"
    file.write_text(body)
    with pytest.raises(ValueError):
        Settings.resolve(file, {})


def test_texts_that_cannot_be_walked_are_blanked(spark):
    deep = "[" * 100_000 + '"token"' + "]" * 100_000
    rows = [(0, deep), (1, '{"token": "x", "note": "\\ud800"}'), (2, '{"note": "\\u00e9"}')]
    got = spark.createDataFrame(rows, "i int, t string").select("i", redact.redact_json(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {0: redact.BLANK, 1: redact.BLANK, 2: '{"note": "é"}'}
