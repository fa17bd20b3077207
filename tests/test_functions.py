import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.functions import dates, text, values
from basketry.plans.reviews import terms


def one(spark, col, **inputs):
    schema = ", ".join(f"{n} {t}" for n, (t, _) in inputs.items())
    return spark.createDataFrame([tuple(v for _, v in inputs.values())], schema).select(col.alias("r")).first().r


RAW = ["  a \t b\n", " x y\x1c", "", "   ", "Não!!! ótimo??  sim.....", "plain"]


@pytest.mark.parametrize("raw", RAW)
def test_white_space_like_python(spark, raw):
    assert one(spark, text.strip_text(F.col("t")), t=("string", raw)) == raw.strip()
    assert one(spark, text.clean_text(F.col("t")), t=("string", raw)) == " ".join(raw.split())
    assert one(spark, text.word_count(F.col("t")), t=("string", raw)) == len(raw.split())


def test_normalize(spark):
    for nfkc in (False, True):
        got = one(spark, text.normalize_text(F.col("t"), nfkc), t=("string", " Não!!! Ótimo??\n fim..... "))
        assert got == "não! ótimo? fim..."
    assert one(spark, text.normalize_text(F.col("t"), True), t=("string", "ﬁm ①")) == "fim 1"
    assert one(spark, text.normalize_text(F.col("t")), t=("string", None)) == ""


def test_whole_words(spark):
    assert one(spark, text.has_word(F.col("t"), "não"), t=("string", "eu não sei"))
    assert not one(spark, text.has_word(F.col("t"), "nao"), t=("string", "naoé"))
    assert one(spark, text.has_accented_latin(F.col("t")), t=("string", "é")) and not one(spark, text.has_accented_latin(F.col("t")), t=("string", "日本"))


def test_terms(spark):
    assert one(spark, terms(F.col("t")), t=("string", "um dois a três")) == ["um", "dois", "três", "um dois", "dois três"]
    assert one(spark, terms(F.col("t")), t=("string", "um")) == ["um"]
    assert one(spark, terms(F.col("t"), (3, 3)), t=("string", "aa bb cc dd")) == ["aa bb cc", "bb cc dd"]


def test_coercion(spark):
    assert one(spark, text.to_num(F.col("t")), t=("string", "x")) is None and one(spark, text.to_num(F.col("t")), t=("string", " 1.5 ")) == 1.5
    assert one(spark, text.to_ts(F.col("t")), t=("string", "2018-13-40")) is None


def test_days(spark):
    a, b = dt.datetime(2018, 1, 1, 23), dt.datetime(2018, 1, 3, 1)
    both = {"a": ("timestamp_ntz", a), "b": ("timestamp_ntz", b)}
    assert one(spark, dates.days_between(F.col("a"), F.col("b")), **both) == 2
    assert one(spark, dates.whole_days(F.col("b"), F.col("a")), **both) == 1
    assert one(spark, dates.whole_days(F.col("a"), F.col("b")), **both) == -2
    assert one(spark, dates.fractional_days(F.col("b"), F.col("a")), **both) == pytest.approx(26 / 24)
    assert one(spark, dates.dow_sunday0(F.col("a")), **both) == 1 and one(spark, dates.dow_monday0(F.col("a")), **both) == 0


def test_month_ends(spark):
    got = [r.month_end for r in dates.month_ends(spark, "2018-01-31", "2018-03-30").collect()]
    assert got == [dt.date(2018, 1, 31), dt.date(2018, 2, 28)]
    assert dates.month_ends(spark, "2018-01-01", "2018-01-30").collect() == []


def test_values(spark):
    assert one(spark, values.target_count(F.col("n"), 0.29), n=("bigint", 100)) == int(100 * 0.29)
    assert one(spark, values.target_count(F.col("n"), 0.01), n=("bigint", 3)) == 1
    assert one(spark, values.ratio(F.col("n"), F.lit(0)), n=("bigint", 3)) is None
    assert one(spark, values.ratio(F.col("n"), F.lit(0), on_zero=0.0), n=("bigint", 3)) == 0.0
    assert one(spark, values.clip(F.col("x"), 0.0, 1.0), x=("double", None)) is None
    edges = values.band(F.col("x"), [0, 1, 2, float("inf")], ["a", "b", "c"], include_lowest=True)
    assert [one(spark, edges, x=("double", v)) for v in (-1.0, 0.0, 1.0, 1.5, 2.0, 9.0, None)] == [None, "a", "a", "b", "b", "c", None]
