"""Measures, pooling, losses and vocabularies."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reqtrail.functions import vectors, vocab


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def unit():
    return F.array(F.lit(1.0), F.lit(0.0))


@pytest.mark.parametrize(("name", "want"), [("cos", 1), ("poly", 2.25), ("sigmoid", math.tanh(2)), ("euc", 1), ("gesd", 0.880797), ("aesd", 0.940399)])
def test_measures(spark, name, want):
    assert one(spark, vectors.similarity(unit(), unit(), name)) == pytest.approx(want, abs=1e-6)


def test_unknown_measure(spark):
    with pytest.raises(ValueError):
        vectors.similarity(unit(), unit(), "none")


def test_zero_vector(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.normalize(zero)) == [None, None]
    assert one(spark, vectors.cosine(zero, unit())) is None


def test_hinge_and_rate(spark):
    assert one(spark, vectors.hinge(F.lit(0.9), F.lit(0.1), 0.4)) == 1e-6
    assert [one(spark, vectors.learning_rate(F.lit(s), 10, 110)) for s in (5, 10, 60, 110)] == pytest.approx([0.5, 1, 0.5, 0], abs=1e-12)
    assert one(spark, vectors.word_weight(F.lit(0))) == 0


def test_max_pool(spark):
    rows = spark.createDataFrame([(1, [1.0, 5.0]), (1, [3.0, 0.0]), (2, [0.0, -1.0])], "id int, v array<double>")
    got = {(r["id"], r["dim"]): r["value"] for r in vectors.max_pool(rows, "id", "v").collect()}
    assert got == {(1, 0): 3.0, (1, 1): 5.0, (2, 0): 0.0, (2, 1): -1.0}


def test_vocabulary(spark):
    words = {"a": 4, "b": 5}
    assert one(spark, vocab.pad(F.array(F.lit(5), F.lit(6)), 4)) == [5, 6, 0, 0]
    assert one(spark, vocab.pad(F.array(F.lit(1), F.lit(2), F.lit(3)), 2)) == [1, 2]
    assert one(spark, vocab.encode(vocab.words(F.lit("A  b z")), words)) == [4, 3, 5, 3]
    assert one(spark, vocab.encode(vocab.words(F.lit("A b")), words, unknown=0)) == [4, 5]
    ids = F.array(*[F.lit(x) for x in (0, 4, 9, 2, 5)])
    assert one(spark, vocab.decode(ids, words)) == "a <unk> <unk>"
    assert one(spark, vocab.decoded_length(ids)) == 3
    assert one(spark, vocab.words(F.lit("it's x"), "token")) == ["it", "'", "s", "x"]
    table = spark.createDataFrame(list(words.items()), "word string, id int")
    rows = spark.createDataFrame([(1, ["b", "q", "a"]), (2, [])], "k int, w array<string>")
    assert dict(vocab.encode_table(rows, "k", "w", table).collect()) == {1: [5, 3, 4], 2: []}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=6), st.integers(1, 8))
def test_round_trip(spark, said, length):
    words = {"a": 4, "b": 5, "c": 6}
    ids = vocab.pad(vocab.encode(F.array(*[F.lit(w) for w in said]).cast("array<string>"), words), length)
    row = spark.range(1).select(ids.alias("ids"), vocab.decode(ids, words).alias("words")).first()
    assert len(row["ids"]) == length and row["words"] == " ".join(said[:length])
