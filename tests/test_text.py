import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import (
    ENGLISH_STOP_WORDS, NOT_KEPT, PRESETS, ASCII_TOKEN, clean, clean_text, drop_empty, strip_message_parts, tokens,
)
from tests.plans import plan

SAMPLE = "Don't  stop--now --- a\nB2!"


@pytest.mark.parametrize(
    ("preset", "expected"),
    [
        ("newsgroups", "don't stop--now a b2 "),
        ("reviews", "don't stop now ab2"),
        ("movie_neg", "on't stop now - a2"),
        ("movie_pos", "on't  stop--now --- a2"),
        ("none", SAMPLE),
    ],
)
def test_presets(spark, preset, expected):
    df = spark.createDataFrame([(SAMPLE,)], "text string")
    assert clean_text(df, preset=preset).first().text == expected


def test_ranges_name_exactly_the_characters_not_kept(spark):
    points = [c for c in [*range(0x3000), 0x4E00, 0xFFFD, 0x1F600, 0x10FFFF] if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "point int, text string")
    kept = {r.point for r in df.where(~F.col("text").rlike(NOT_KEPT)).select("point").collect()}
    assert kept == {c for c in points if re.fullmatch(r"[a-z0-9\-' ]", chr(c))}


@pytest.mark.parametrize("preset", [p for p in PRESETS if p != "none"])
def test_presets_against_plain_patterns(spark, preset):
    texts = [SAMPLE, "", " ", "\n\n", "Über--- - -- CAFÉ's -", "a -- b --- c - d", "x\t- y", "---", "😀a😀 b", " -  - "]
    lower, steps = PRESETS[preset]
    expected = []
    for text in texts:
        text = text.lower() if lower else text
        for pattern, by in steps:
            text = re.sub(r"[^a-z0-9\-' ]" if pattern == NOT_KEPT else pattern, by, text)
        expected.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r.text for r in clean_text(df, preset=preset).orderBy("i").collect()] == expected


def test_own_rules_replace_the_preset(spark):
    df = spark.createDataFrame([("A b",)], "text string")
    assert df.select(clean("text", rules=[F.upper, lambda c: F.replace(c, F.lit(" "), F.lit("_"))])).first()[0] == "A_B"


def test_unknown_preset():
    with pytest.raises(ValueError):
        clean(F.lit("a"), "nope")


def test_drop_empty_keeps_a_space(spark):
    df = spark.createDataFrame([("",), (" ",), (None,), ("a",)], "text string")
    assert sorted(r.text for r in drop_empty(df).collect()) == [" ", "a"]


def test_tokens(spark):
    df = spark.createDataFrame([("don't stop now ab2 A x_y",), ("Ça été",), ("",)], "text string")
    got = [r[0] for r in df.select(tokens("text")).collect()]
    assert got == [["don", "stop", "now", "ab2", "x_y"], ["ça", "été"], []]
    assert [r[0] for r in df.select(tokens("text", ASCII_TOKEN)).collect()] == [["don", "stop", "now", "ab2", "x_y"], [], []]


MESSAGE = "From: a@b\nSubject: x\n\nIn article 5 someone wrote:\n> quoted\n| also\nhello there\nsecond line\n\n--\nAnn\nCity\n"


@pytest.mark.parametrize(
    ("text", "parts", "expected"),
    [
        (MESSAGE, {}, "hello there\nsecond line\n"),
        (MESSAGE, {"footers": False}, "hello there\nsecond line\n\n--\nAnn\nCity\n"),
        ("one block\nonly", {"headers": False}, "one block\nonly"),
        ("no blank line", {}, ""),
        ("body\n\nsignature", {"headers": False}, "body"),
        ("body\n---\nsignature\n", {"headers": False}, "body"),
        ("-- \nall of it", {"headers": False}, "-- \nall of it"),
        ("", {}, ""),
        (None, {}, None),
    ],
)
def test_strip_message(spark, text, parts, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert strip_message_parts(df, **parts).first().text == expected


def test_strip_message_of_many_lines(spark):
    long = "h: v\n" * 30000 + "\n" + "> q\nline\n" * 30000
    df = spark.createDataFrame([(long,)], "text string")
    assert strip_message_parts(df).first().text == ("line\n" * 30000)


def test_text_functions_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("a",)], "text string")
    assert "Python" not in plan(strip_message_parts(clean_text(df)).select(tokens("text")))


def test_column_functions_work_on_streams(spark, tmp_path):
    spark.createDataFrame([(SAMPLE,), ("",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    query = (
        drop_empty(clean_text(stream)).select(tokens("text").alias("tokens"))
        .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    assert query.awaitTermination(60)
    assert [r.tokens for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [["don", "stop", "now", "ab2"]]


def test_stop_word_list():
    assert len(ENGLISH_STOP_WORDS) == len(set(ENGLISH_STOP_WORDS)) == 179
