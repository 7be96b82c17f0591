"""Expected values written by hand."""

import pytest
from pyspark.sql import functions as F

from curata.functions import jsonrepair as J
from curata.functions import keys as K
from curata.functions import labels as L
from curata.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    """The values of expressions of literals, evaluated in one job by Spark's expressions, not folded away."""

    def run(*columns):
        row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
        return list(row)

    return run


def test_text(value):
    x = F.lit
    assert value(
        T.clean_text(x(" a \n b\x1cc ")), T.dedupe_comma_phrases(x("Cat, dog; CAT , . ,bird.")), T.has_repeated_comma_phrases(x("a,b,c,A")), T.has_repeated_comma_phrases(x("a,b,A")),
        T.trim_words(x("a b  c"), 2), T.sanitize_title(x('"Big" {news}: [x] | y.')), T.slugify(x("A b/c--d  é?")), T.slugify(x("??")), T.canonical_key(x("SDXL Prompt!")), T.for_similarity(x("A_b--C")),
        T.has_char_run(x("a" * 13)), T.has_char_run(x("a" * 12)), T.has_word_run(x("x Go go GO go")), T.has_word_run(x("go go go")), T.has_token_repetition(x("a b c a b c a b c")), T.has_token_repetition(x("a b c a b c a b")),
        T.text_list(x('["a", {"text": "b"}, "", " c d"]')), T.text_list(x("a; b,,c")), T.text_value(x('["a","","b"]')), T.trim_words(T.fallback_prompt(x(" ")), 2),
        T.is_negated(x("with no readable texts"), "readable text"), T.is_negated(x("readable text"), "readable text"), T.is_negated(x("watermark-free"), "watermark"),
    ) == [
        "a b c", "Cat, dog, bird", True, False, "a b", "Big news : x y", "A_b_c--d_é", "item", "sdxlprompt", "a b c", True, False, True, False, True, False,
        ["a", "b", "c d"], ["a", "b", "c"], "a, b", "news event.", True, False, True,
    ]


def test_labels(value):
    x, n = F.lit, lambda s: L.normalize_label(F.lit(s), L.STYLE_TYPES)
    assert value(n("map"), n("Real photo"), n("map|junk"), n("map|chart"), n(None), n("hm"), L.normalize_label_list(x("portrait, Event Scene"), L.VISUAL_ROLES), L.normalize_bool(x("YES")), L.normalize_bool(x("x"), False), L.normalize_open_list(x("a, b; c"))) == [
        "map", "photograph", "map", "uncertain", "uncertain", "uncertain", ["portrait", "event_scene"], True, False, ["a, b", "c"],
    ]
    got = value(L.visible_text(x("Hi")), L.visible_text(x("x" * 31)), L.visible_text(x("no")), L.visible_text(x(" ")))
    assert [tuple(r) for r in got] == [("small_amount", "Hi"), ("large_amount", "x" * 31), ("uncertain", ""), ("none", "")]


@pytest.mark.parametrize(
    "raw,want",
    [
        ('```json\n{"a": "1"}\n```', {"a": "1"}), ('Sure: {"a": "1"} done', {"a": "1"}), ('[{"a": "1"}]', {"a": "1"}), ('{"a":"1",}', {"a": "1"}), ('{"a": "\\&1"}', {"a": "&1"}),
        ('{"a": "some value""}', {"a": "some value"}), ('{"\ta": "1"}', {"a": "1"}), ('{"a": "http://x#y", // note\n"b": "2"}', {"a": "http://x#y", "b": "2"}), ("{'a': 'b', 'c': None}", {"a": "b", "c": None}),
        ("no object", None), ("", None), ('{"a": ', None),
    ],
)
def test_json(value, raw, want):
    assert value(J.parse_object(F.lit(raw))["object"]) == [want]


def test_keys(spark, value):
    top = K.TOP_KEYS
    assert value(K.exact_key(F.lit("visualPlan"), top), K.exact_key(F.lit("caption"), top), K.exact_key(F.lit("x"), top), K.partial_key(F.lit("title understand"), top), K.partial_key(F.lit("prompt"), top)) == ["generation_plan", "ranking_caption", None, "title_understanding", "sdxl_prompt"]
    assert K.close_key("negatve promt", top) == "negative_prompt" and K.close_key("weather", top) is None
    df = spark.createDataFrame([("negatve promt",), ("caption",), ("weather",), (None,)], "key string")
    assert {r.key: r.mapped for r in K.map_keys(df, "key", top).collect()} == {"negatve promt": "negative_prompt", "caption": "ranking_caption", "weather": None, None: None}
