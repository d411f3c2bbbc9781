"""Golden rows of the text functions."""

import pytest
from pyspark.sql import functions as F

from agora.functions import text as T
from agora.functions.dates import detect
from agora.operators import refine as P


def apply(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "text,clean",
    [
        (None, ""),
        ("", ""),
        ("see https://ex.org/a?b=1 now", "see now"),
        ("thanks u/some_user and r/cars", "thanks and"),
        ("[label](http://x.y) tail", "label tail"),
        ("**bold** _it_", "bold it"),
        ("&amp;amp; x", "x"),
        ("I`m `x`", "I'm x"),
        (">no space", ">no space"),
        ("a\n> quoted text\nb", "a b"),
        ("a ```code\nmore``` b", "a b"),
        ("“q” …", '"q" ...'),
        ("zero​width", "zero width"),
        ("&eacute;t&eacute;", "été"),
    ],
)
def test_clean(spark, text, clean):
    assert apply(spark, T.clean, text) == [clean]


def test_mojibake_drops_what_is_no_utf8(spark):
    assert apply(spark, T.repair_mojibake, "cafÃ©", "plain é", "châteaux") == ["café", "plain é", "chteaux"]


def test_token_count(spark):
    assert apply(spark, T.token_count, None, "", "  ", "a", "a b\tc ") == [0, 0, 0, 1, 3]


def test_title_case(spark):
    assert apply(spark, T.title_case, "e-golf 3rd ev") == ["E-Golf 3Rd Ev"]


def test_singular(spark):
    words = ["batteries", "glass", "bus", "cars", "ies"]
    assert apply(spark, P.singular, *words) == ["battery", "glass", "bus", "car", "ies"]


def test_list_parsing(spark):
    got = apply(spark, P.parse_list, "['a', 'b c']", "a, b", "plain", "", None, "('x',)")
    assert got == [["a", "b c"], ["a", "b"], ["plain"], [], [], ["x"]]


def test_jaccard_of_exactly_the_limit_is_a_copy(spark):
    phrases = ["alpha beta gamma delta", "alpha beta gamma delta epsilon", "omega"]
    df = spark.createDataFrame([(phrases,)], "p array<string>")
    assert df.select(P.distinct_phrases(F.col("p"), F.array(F.lit("the")))).first()[0] == [phrases[0], "omega"]


def test_epochs(spark):
    day = "2024-01-02 00:00:00"
    for value in ("1704153600", "1704153600000", "2024-01-02"):
        df = spark.createDataFrame([(value,)], "c string")
        assert detect(df, "c").select(F.date_format("created_dt", "yyyy-MM-dd HH:mm:ss")).first()[0] == day


def test_half_numbers_are_texts(spark):
    df = spark.createDataFrame([("1704153600",), ("2024-01-02",)], "c string")
    assert [str(r.created_dt) for r in detect(df, "c").collect()][1].startswith("2024-01-02")
