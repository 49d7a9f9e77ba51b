import random

from pyspark.sql import functions as F

from trawlspark.functions import text as X, vectors as V

from .conftest import rows


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()[0]


def test_tokens_by_word_and_pair(spark):
    queries = spark.createDataFrame([(1, "ab abc z"), (2, "　\t "), (3, None)], "query_id long, query string")
    assert rows(X.query_tokens(queries)) == [(1, "ab", 2.0), (1, "abc", 1.0), (1, "bc", 0.5), (1, "z", 1.0)]
    assert X.token_weights("ab abc z") == {"ab": 2.0, "abc": 1.0, "bc": 0.5, "z": 1.0}


def test_token_weight_sum(spark):
    r = random.Random(3)
    for _ in range(50):
        words = ["".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 6))]
        assert sum(X.token_weights(" ".join(words)).values()) == len(words) + 0.5 * sum(len(w) - 1 for w in words)


def test_match_is_case_sensitive(spark):
    assert one(spark, X.match_score(F.lit("Hello"), {"hell": 1.0})) == 0.0
    assert one(spark, X.match_score(F.lit("Hello"), {"Hell": 1.0, "o": 0.5})) == 1.5


def test_footnotes_fences_and_numbers(spark):
    assert one(spark, X.strip_footnotes(F.lit("a1) b12)c"))) == "a bc"
    assert one(spark, X.strip_fences(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, X.strip_outer_fence(F.lit("```JSON {}```"))) == "{}"
    assert one(spark, X.strip_outer_fence(F.lit("{} ```"))) == "{} ```"
    found = [one(spark, X.whole_number(F.lit(x))) for x in ("3", "3.7", "x", " 4 ", "", "-2")]
    assert found == [3, 3, None, 4, None, -2]
    assert [one(spark, X.strict_number(F.lit(x))) for x in ("3", "1.5", " 12 ", "+3")] == [3, None, 12, 3]


def test_labels_and_keys(spark):
    label = lambda s, e: one(spark, X.range_label(F.lit("B"), F.lit(1), F.lit(s), F.lit(e)))
    assert (label(3, 3), label(3, 5)) == ("B 1:3", "B 1:3-5")
    keys = lambda s, e: one(spark, X.verse_keys(F.lit("B"), F.lit(1), F.lit(s), F.lit(e)))
    assert keys(2, 3) == ["B:1:2", "B:1:3"] and keys(3, 2) == []


def test_quantizing(spark):
    vectors = spark.createDataFrame([(0, [0.0, 2.5, 3.5, 255.0])], "id long, embedding array<float>")
    from trawlspark.sources.files import quantized_table

    assert quantized_table(vectors)[0].first()["q"] == [0, 2, 4, 255]
    flat = spark.createDataFrame([(0, [1.5, 1.5])], "id long, embedding array<float>")
    assert quantized_table(flat)[0].first()["q"] == [0, 0]


def test_cosine_of_nothing(spark):
    v = F.lit([0.0, 0.0])
    assert one(spark, V.cosine(v, V.norm(v), F.lit([1.0, 0.0]), F.lit(1.0))) == 0.0
