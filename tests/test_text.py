"""Rules on text, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from reqtrail.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "want"),
    [("A server MUST reject a 400 x_1 _a", ["SERVER", "MUST", "REJECT", "X_1", "_A"]), ("", []), ("1 2 3 é", [])],
)
def test_tokenize(spark, said, want):
    assert one(spark, text.tokenize(F.lit(said))) == want


def test_overlap(spark):
    need = text.token_set(F.lit("A server MUST send a Date header"))
    have = text.token_set(F.lit("int send_date(void){ if (server) send(Date); return header; }"))
    assert one(spark, text.overlap(need, have)) == pytest.approx(0.8)
    assert one(spark, text.overlap(text.token_set(F.lit("1")), have)) == 0.0


@pytest.mark.parametrize(
    ("cell", "want"),
    [('["GET", "HEAD"]', ["GET", "HEAD"]), ('[" a"]', [" a"]), ('["x, y"]', ["x", "y"]), ("[]", []), ("", []), (None, []), ("\t[\"a\"] ,b", ["a", "b"])],
)
def test_cells(spark, cell, want):
    assert one(spark, text.split_cell(F.lit(cell).cast("string"))) == want


def test_typed_cell(spark):
    assert one(spark, text.typed_cell(F.lit('["x, y", ""]'))) == ["x, y"]
    assert one(spark, text.typed_cell(F.lit("no list"))) == []


def test_lists(spark):
    assert one(spark, text.cell_to_list(F.lit(""))) == []
    assert one(spark, text.cell_to_list(F.lit("a,b"))) == ["a", "b"]
    assert one(spark, text.list_to_json(F.array(F.lit("é"), F.lit('"')))) == '["é","\\""]'


@pytest.mark.parametrize(("said", "want"), [("respond 100 now", ["100"]), ("100-continue", []), ("(Continue)", ["100"]), ("port 2000", ["200"]), ("it is OK", ["200"])])
def test_status_codes(spark, said, want):
    assert one(spark, text.status_codes(F.lit(said), {"200": "OK", "100": "Continue"})) == want


@pytest.mark.parametrize(("said", "words", "want"), [("Page Age", ["Age"], ["Age"]), ("Pages", ["Age"], []), ("éAge", ["Age"], []), ("a.b", ["a.b"], ["a.b"]), ("axb", ["a.b"], []), ("c++x", ["c++"], ["c++"]), ("c++ x", ["c++"], [])])
def test_words(spark, said, words, want):
    assert one(spark, text.keywords_word(F.lit(said), words)) == want


def test_keywords(spark):
    assert one(spark, text.keywords_ci(F.lit("xGETy"), ["get", "", "PUT"])) == ["get"]
    assert one(spark, text.keywords_plain(F.lit("xGETy"), ["get", "GET"])) == ["GET"]
    assert text.ordered_keywords(["GET", "100", "a", "PUT", "Continue", "a"]) == ["a", "100", "GET", "PUT", "Continue"]
    rules = text.keyword_columns(F.lit(None).cast("string"), {"status_code": {"100": "Continue"}, "method": ["GET"]})
    assert spark.range(1).select(*[v.alias(k) for k, v in rules.items()]).first().asDict() == dict.fromkeys(rules, "")


def test_context(spark):
    assert one(spark, text.context(F.lit(""), F.lit("c"), F.lit("n"))) == "Current paragraph:\nc\n\nNext paragraph:\nn"
    assert one(spark, text.context(F.lit("p"), F.lit("c"), F.lit(None).cast("string"))) == "Previous paragraph:\np\n\nCurrent paragraph:\nc\n"


def test_json(spark):
    fenced = 'So ```json\n{"a":[1]}\n``` and ```json {} ```'
    assert one(spark, text.fenced_json(F.lit(fenced))) == '{"a":[1]}'
    assert one(spark, text.fenced_json(F.lit("```json```"))) == ""
    assert one(spark, text.fenced_json(F.lit("plain"))) == "plain"
    assert one(spark, text.recovered_json(F.lit('pre {"a":{}} post'), "a map<string,int>"))["a"] == {}
    assert one(spark, text.recovered_json(F.lit('```\n{"a": 3}\n```'), "a int"))["a"] == 3
    assert one(spark, text.recovered_json(F.lit('{"a": 3}'), "a int"))["a"] == 3
    assert one(spark, text.recovered_json(F.lit("nothing { here"), "a int")) is None
    assert one(spark, text.json_list(F.lit('{"b": ["x"]}'), "a")) == []
    assert one(spark, text.json_list(F.lit('{"a": ["x"]}'), "a")) == ["x"]


def test_small_rules(spark):
    assert one(spark, text.normalize_query(F.lit("How to sort a list?"))) == "sort a list"
    assert one(spark, text.elapsed(F.lit(125.9))) == "2:5"
    assert one(spark, text.remaining(F.lit(60.0), F.lit(0.5))) == "1:0<1:0"
    assert text.call_options("o3-mini", 5) == {"max_completion_tokens": 5}
    assert text.call_options(None, 5) == {"max_tokens": 5, "temperature": 0}
    assert text.endpoint("lite", {"lite": "x"}) == "x"
    with pytest.raises(ValueError):
        text.endpoint("huge", {"lite": "x"})
