import math

import numpy as np
import pyspark.sql.functions as F
import pytest

from rankspark.config import Config, strtobool
from rankspark.functions import scores as S
from rankspark.functions import text as T
from rankspark.functions import vectors as V


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "title, want",
    [
        ("[85] [90] x (TS: 4) (TS: 5)", "x (TS: 4)"),
        ("a [12] b (TS: 3)\n", "a b"),
        ("[٣] x (TS: ٤)", "x"),
        ("[a] x", "[a] x"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_title(spark, title, want):
    assert one(spark, title, "string", T.clean_title) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p>a</p><p>b &amp; c", "a b & c"),
        ("<script>if (a<b) x</script>y<style>p{}</style>z", "y z"),
        ("a<!-- no -->b", "a b"),
        ("x &lt; y", "x < y"),
        ("plain  text\n", "plain text"),
        ("", ""),
        (None, None),
    ],
)
def test_strip_html(spark, source, want):
    assert one(spark, source, "string", T.strip_html) == want


def test_html_forms_agree_without_entities(spark):
    text = "<p>One <b>two</b>\nthree</p><!-- c --><script>var x='<p>'</script><style>a</style>" * 3
    assert one(spark, text, "string", T.strip_markup) == T.html_to_text(text)


def test_collapse_and_words(spark):
    assert one(spark, "  a  b\n", "string", T.collapse_whitespace) == "a b"
    assert one(spark, "a b  c", "string", lambda c: T.word_head(c, 2)) == "a b"
    assert one(spark, "a b", "string", lambda c: T.word_head(c, 0)) == ""
    assert one(spark, "a b", "string", lambda c: T.word_head(c, -3)) == ""


def test_normalise():
    assert T.normalise("Łódź  STRASSE ß\r\n\r\nŽena “q”") == 'lodz strasse ss\nzena "q"'
    assert T.normalise("Щука") == "shchuka"
    assert T.normalise("") == ""


@pytest.mark.parametrize("budget, want", [(4, "a"), (0, "a"), (6, "a b"), (7, "a b x"), (9, "a b x y z"), (100, "a b x y z")])
def test_title_head(spark, budget, want):
    assert T.title_head_text("[1] A b", "<p>x y</p>z", budget) == want
    frame = spark.createDataFrame([("[1] a b", "<p>x y</p>z")], "t string, c string")
    assert frame.select(T.title_head_words(F.col("t"), F.col("c"), budget)).first()[0] == want


def test_title_head_drops_empty_parts():
    assert T.title_head_text(None, "x", 20, separator="|") == "x"
    assert T.title_head_text("a", None, 20, separator="|") == "a"
    assert T.title_head_text("a", "x", 20, separator="|") == "a | x"


def test_unknown_mode():
    with pytest.raises(ValueError):
        T.prepared("other", F.lit("a"), F.lit("b"))


def test_prompt(spark):
    assert spark.range(1).select(T.prompt("{title}: {content}", F.lit("t"), F.lit(None).cast("string"))).first()[0] == "t: "


@pytest.mark.parametrize("p, want", [(0.005, 0), (0.015, 2), (0.025, 2), (0.5, 50), (None, None)])
def test_to_score_rounds_half_to_even(spark, p, want):
    assert one(spark, p, "double", S.to_score) == want


def test_decay(spark):
    def value(score, days, urgency):
        row = spark.createDataFrame([(score, days, urgency)], "s int, d double, u double")
        return row.select(S.decayed(F.col("s"), F.col("d"), F.col("u"))).first()[0]

    assert value(80, 10.0, 1.0) == 40
    assert value(80, 120.0, 0.0) == 40
    assert value(80, 65.0, 0.5) == 40
    assert value(80, -10.0, 1.0) == 160  # a date after the clock raises the score
    assert value(80, 10.0, None) == 80
    assert value(80, -1e6, 1.0) == 2147483647


def test_age(spark):
    row = spark.sql("select timestamp_ntz'2024-02-01 12:00:00' a, timestamp_ntz'2024-01-31 00:00:00' b")
    assert row.select(S.age_days(F.col("a"), F.col("b"))).first()[0] == 1.5


def test_clip(spark):
    assert one(spark, 1.0, "double", S.clipped) == 1 - 1e-7
    assert one(spark, None, "double", S.clipped) is None


def test_codec(spark):
    vectors = [[1.5, -2.25, 0.0], [], None]
    rows = spark.createDataFrame([(v,) for v in vectors], "v array<float>").withColumn("p", V.pack("v"))
    assert [r[0] for r in rows.select(V.unpack("p")).collect()] == vectors
    assert [None if r[0] is None else len(r[0]) for r in rows.select("p").collect()] == [12, 0, None]
    assert rows.first()["p"] == np.array([1.5, -2.25, 0], "<f4").tobytes()


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0],), ([float("nan"), 1.0],), (None,)], "v array<float>")
    assert [r[0] for r in rows.select(V.norm(F.col("v"))).limit(2).collect()] == [5.0, 0.0]
    assert [r[0] for r in rows.select(V.usable(F.col("v"), 2)).collect()] == [True, True, False, False, False]
    assert rows.select(V.dot(F.col("v"), [1.0, 2.0])).collect()[0][0] == 11.0
    assert rows.select(V.dot(F.col("v"), [1.0, 2.0])).collect()[2][0] is None
    assert math.isclose(sum(x * x for x in rows.select(V.unit(F.col("v"))).first()[0]), 1, rel_tol=1e-6)


def test_config():
    assert strtobool("Yes") and not strtobool("off")
    with pytest.raises(ValueError):
        strtobool("maybe")
    c = Config.from_env({"EXCELLENT_WEIGHT": "2", "ALLOW_TRAINING_WO_GPU": "true", "SAMPLING": "7"})
    assert (c.excellent_weight, c.allow_training_wo_gpu, c.sampling) == (2.0, True, 7)
    assert c.urgency_model_key.startswith("urgency-embedding_linear::")
    for bad in ({"half_life_urgent": 200.0}, {"half_life_urgent": 0.0}, {"relevance_text_prep_mode": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)
