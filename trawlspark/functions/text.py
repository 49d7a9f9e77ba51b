"""Text expressions: white space, tokens, keys, labels, replies of models."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# The white space that ends a word of a query, the weights of a word and of a pair of characters.
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WORD_WEIGHT, PAIR_WEIGHT = 1.0, 0.5
DEFAULT_TAGS = "믿음 소망 사랑"
MAX_QUERY, MAX_IDS = 300, 10_000


def trim_all(text: Column) -> Column:
    """Trim any white space; the built-in trims spaces only."""
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def token_array(query: Column) -> Column:
    """Array of (token, weight) for each word and each pair of adjacent characters of a query, with repetitions."""
    words = F.filter(F.split(trim_all(query), f"[{SPACES}]+"), lambda w: w != "")
    word = F.transform(words, lambda w: F.struct(w.alias("token"), F.lit(WORD_WEIGHT).alias("weight")))
    pairs = F.flatten(
        F.transform(
            words,
            lambda w: F.when(
                F.length(w) > 1,
                F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.struct(F.substr(w, i, F.lit(2)).alias("token"), F.lit(PAIR_WEIGHT).alias("weight"))),
            ).otherwise(F.array().cast("array<struct<token:string,weight:double>>")),
        )
    )
    return F.concat(word, pairs)


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, weight) with weights summed, for ``queries`` (query_id, query)."""
    rows = queries.select("query_id", F.explode(token_array(F.col("query"))).alias("t"))
    return rows.groupBy("query_id", F.col("t.token").alias("token")).agg(F.sum("t.weight").alias("weight"))


def token_weights(query: str) -> dict[str, float]:
    """The same for one query on the driver; its length is bounded by ``MAX_QUERY``."""
    weights: dict[str, float] = {}
    for word in filter(None, re.split(f"[{SPACES}]+", query)):
        for token, weight in [(word, WORD_WEIGHT), *((word[i : i + 2], PAIR_WEIGHT) for i in range(len(word) - 1))]:
            weights[token] = weights.get(token, 0.0) + weight
    return weights


def search_text(ko: Column, en: Column, embed: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (ko, en, embed)])


def match_score(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the tokens that a text contains, case-sensitive; one codegen expression, no join."""
    score = F.lit(0.0)
    for token, weight in sorted(weights.items()):
        score = score + F.when(F.contains(text, F.lit(token)), F.lit(weight)).otherwise(F.lit(0.0))
    return score


def strip_footnotes(text: Column) -> Column:
    return trim_all(F.regexp_replace(text, r"\d+\)", ""))


def embed_text(ko: Column, en: Column, tags: Column) -> Column:
    return F.concat(ko, F.lit(" "), en, F.lit(" | 태그: "), tags)


def strip_fences(text: Column) -> Column:
    """Code fences of a reply, wherever they are."""
    return trim_all(F.regexp_replace(text, "```json\\n?|\\n?```", ""))


def strip_outer_fence(text: Column) -> Column:
    """Only if the text starts with a fence: the fences around it and a leading word json."""
    t = trim_all(text)
    inner = F.regexp_replace(F.regexp_replace(t, "^`+|`+$", ""), r"(?i)^json\s*", "")
    return F.when(t.startswith("```"), trim_all(inner)).otherwise(t)


def whole_number(text: Column) -> Column:
    """An int as a lenient parser reads it: 3, "3" and 3.7 give 3, others null."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+)(\.\d+)?\s*$", 1)
    return number.try_cast("int")


def strict_number(text: Column) -> Column:
    """An int written as digits with a sign at most, others null."""
    own = trim_all(text)
    return F.when(own.rlike(r"^[+-]?\d+$"), own.try_cast("int"))


def range_label(book: Column, chapter: Column, start: Column, end: Column) -> Column:
    one = F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), start.cast("string"))
    return F.when(start == end, one).otherwise(F.concat(one, F.lit("-"), end.cast("string")))


def verse_key(book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat_ws(":", book, chapter.cast("string"), verse.cast("string"))


def key_parts(key: Column) -> Column:
    """Struct (book, chapter, verse) of a verse's key; null where it hasn't three parts or one of the numbers is none."""
    parts = F.split(key, ":", -1)
    chapter, verse = strict_number(F.get(parts, F.lit(1))), strict_number(F.get(parts, F.lit(2)))
    return F.when((F.size(parts) == 3) & chapter.isNotNull() & verse.isNotNull(), F.struct(F.get(parts, F.lit(0)).alias("book"), chapter.alias("chapter"), verse.alias("verse")))


def verse_keys(book: Column, chapter: Column, start: Column, end: Column) -> Column:
    keys = F.transform(F.sequence(start, end), lambda v: verse_key(book, chapter, v))
    return F.when(start <= end, keys).otherwise(F.array().cast("array<string>"))


def segment_id(book: Column, chapter: Column, start: Column, end: Column) -> Column:
    return F.concat(book, F.lit(":"), chapter.cast("string"), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def as_text(field: Column) -> Column:
    """A request field as text, empty where it is missing."""
    return F.coalesce(field.cast("string"), F.lit(""))


def truthy(text: Column) -> Column:
    """A request field as a flag the way a script language reads it: any text but an empty one is true."""
    return F.coalesce(text != "", F.lit(False))
