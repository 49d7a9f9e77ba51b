"""Quality rules: base counts of a text, and its distance from language references.

A document's histogram of character classes and its histogram of common words are compared to those of each reference
language by the Jensen-Shannon distance (logarithm to base 2, square root taken, so between 0 and 1). References are the
mean histograms over all documents of a language. Three guards leave a text to the base rules alone, as no distance can
speak for or against it: too few words for a histogram, a language that has no reference, or a script that isn't that of
the references.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..workers import map_arrow
from .shared import as_bytes, cut

# Frequent words of the reference languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will more no if out so what",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la aux d l avec ou cette été son mais comme on nous sa fait elle tout ses été leur ils même",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy",
}
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEATED_PERCENT = 50, 50
#: Words from which a distance counts. A distance is kept up to a limit plus an allowance over the root of the number of
#: words, as chance moves the histogram of a short text away from any reference.
GUARD_WORDS = 50
CLASS_LIMIT, CLASS_ALLOWANCE = 0.12, 1.0
WORD_LIMIT, WORD_ALLOWANCE = 0.21, 2.0

CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other_ascii", "beyond_ascii")
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def _byte_classes() -> np.ndarray:
    """For each byte the class that it adds one character to; bytes inside a character add to none."""
    table = np.full(256, len(CLASSES), np.int64)
    for b in range(0xC0):
        c = chr(b)
        if b < 0x80:
            table[b] = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\v\f\r" else 4 if c in ".,;:!?'\"()-" else 5 if c in "#*$%&|<>@^_~`+=/\\[]{}" else 6
    table[0xC0:] = 7
    return table


_BYTE_CLASS = _byte_classes()
#: Places of the words in VOCABULARY, in small letters, capitals or with one capital, and with at most one mark behind.
_PLACE = {(form + mark).encode(): i for i, w in enumerate(VOCABULARY) for form in (w, w.capitalize(), w.upper()) for mark in ("", *".,;:!?")}


def text_counts(text: bytes) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, counts of VOCABULARY and the rest)."""
    words = text.split()
    n = len(words)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(_BYTE_CLASS, weights=by_byte, minlength=len(CLASSES) + 1)[: len(CLASSES)].astype(np.int64)
    symbols = int(sum(by_byte[ord(c)] for c in SYMBOLS))
    seen: set[bytes] = set()
    duplicates = 0
    for line in text.split(b"\n"):
        if line in seen:
            duplicates += 1
        elif line.strip():
            seen.add(line)
    number: dict[bytes, int] = {}
    codes = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    common = np.zeros(len(VOCABULARY) + 1, np.int64)
    if n:
        places = [p if (p := _PLACE.get(w)) is not None else len(VOCABULARY) for w in number]
        common = np.bincount(places, weights=np.bincount(codes, minlength=len(number)), minlength=len(common)).astype(np.int64)
    return n, int(classes.sum() - classes[3]), symbols, duplicates, _repeated(codes, len(number)), classes.tolist(), common.tolist()


def _repeated(codes: np.ndarray, distinct: int, most: int = 1 << 21) -> int:
    """Words inside 3-word windows that the text holds twice or more. Numbers stand for windows without collisions."""
    if len(codes) < 4:
        return 0
    if distinct >= most:  # the product of three numbers would not fit: number the pairs first
        first = np.unique(codes[:-1] * distinct + codes[1:], return_inverse=True)[1]
        window = first[:-1] * distinct + codes[2:]
    else:
        window = (codes[:-2] * distinct + codes[1:-1]) * distinct + codes[2:]
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(window, twice)
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : len(codes) - 2 + k] |= again
    return int(covered.sum())


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of ``text_counts`` for every row; null text has no words."""
    import pyarrow as pa

    schema = docs.select("doc_id", "lang").schema.add("n_words", "long").add("word_chars", "long").add("n_symbols", "long").add("n_dup_lines", "long").add("n_repeat_words", "long").add("classes", T.ArrayType(T.IntegerType())).add("common", T.ArrayType(T.IntegerType()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                found = list(zip(*map(text_counts, as_bytes(some.column("text"))), strict=True))
                arrays = [pa.array(c, pa.int64()) for c in found[:5]] + [pa.array(c, pa.list_(pa.int32())) for c in found[5:]]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("lang"), *arrays], names=schema.names)

    return map_arrow(docs.select("doc_id", "lang", "text"), count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def references(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language of COMMON_WORDS that has a document that passes the base rules: mean shares of classes and words.

    Each task sums its documents' shares; one number for each language and bin reaches the driver, whatever the input.
    """
    import pyarrow as pa

    widths = {"classes": len(CLASSES), "common": len(VOCABULARY) + 1}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros(1 + sum(widths.values())) for lang in COMMON_WORDS}
        for batch in batches:
            rows = [batch.column(c).flatten().to_numpy().reshape(-1, w).astype(float) for c, w in widths.items()]
            shares = np.hstack([np.ones((batch.num_rows, 1)), *(r / np.maximum(r.sum(axis=1, keepdims=True), 1) for r in rows)])
            lang = np.array(batch.column("lang").to_pylist(), object)
            for name, total in sums.items():
                total += shares[lang == name].sum(axis=0)
        for name, total in sums.items():
            if total[0]:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(total)), pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["lang", "bin", "total"])

    known = counts.where(F.col("lang").isin(*COMMON_WORDS) & ~base_failed()).select("lang", *widths)
    found: dict[str, dict[int, float]] = {}
    for lang, bin_, total in map_arrow(known, add, "lang string, bin int, total double").groupBy("lang", "bin").agg(F.sum("total")).collect():
        found.setdefault(lang, {})[bin_] = total
    k = 1 + len(CLASSES)
    means = {lang: np.array([bins[i] for i in range(len(bins))]) / bins[0] for lang, bins in sorted(found.items())}
    return {lang: (mean[1:k], mean[k:]) for lang, mean in means.items()}


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from the reference."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = np.asarray(reference)[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def judge(docs: DataFrame, guard: int = GUARD_WORDS, classes: tuple[float, float] = (CLASS_LIMIT, CLASS_ALLOWANCE), words: tuple[float, float] = (WORD_LIMIT, WORD_ALLOWANCE)) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, base_failed, class_distance, word_distance, kept.

    Reads doc_id, text and lang; other columns are ignored. A document whose language has a reference is measured against
    every reference and judged by the nearest, so one of these languages in place of another doesn't reject it. Distances
    are null, and the base rules alone judge, where a text has under ``guard`` words, where its lang is null or has no
    reference (the languages of ``COMMON_WORDS`` have, if a document of theirs passes the base), and where more of its
    letters are beyond ASCII than in it, as in scripts that the references don't have. Null and empty texts have no words
    and fail the base. Texts of any length are counted whole. Repeated rows repeat; an empty table gives no rows.
    """
    import pyarrow as pa

    counts = cut(counted(docs))
    known = references(counts)
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = counts.select("doc_id", *numbers).schema.add("class_distance", "double").add("word_distance", "double")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            able = (batch.column("n_words").to_numpy() >= guard) & np.isin(np.array(batch.column("lang").to_pylist(), object), list(known))
            letters = batch.column("classes").flatten().to_numpy().reshape(-1, len(CLASSES))
            able &= letters[:, CLASSES.index("beyond_ascii")] <= letters[:, 0] + letters[:, 1]
            found = []
            for name, k, size in (("classes", 0, len(CLASSES)), ("common", 1, len(VOCABULARY) + 1)):
                rows = batch.column(name).flatten().to_numpy().reshape(-1, size).astype(float)
                nearest = np.min([distance(rows, r[k]) for r in known.values()], axis=0) if known else np.zeros(len(rows))
                found.append(pa.array(nearest, pa.float64(), mask=~able))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in numbers), *found], names=schema.names)

    measured = map_arrow(counts.select("doc_id", "lang", *numbers, "classes", "common"), measure, schema).withColumn("base_failed", base_failed())

    def near(name: str, limit: float, allowance: float) -> Column:
        return F.coalesce(F.col(name) <= limit + allowance / F.sqrt("n_words"), F.lit(True))

    return measured.withColumn("kept", ~F.col("base_failed") & near("class_distance", *classes) & near("word_distance", *words))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Rows are matched by doc_id and a hash of the text, so rows that share an id are judged one by one; equal rows share
    their verdict. The text is shuffled once, the verdicts are narrow.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    judged = judge(docs.select(F.struct("doc_id", mark.alias("mark")).alias("doc_id"), "text", "lang"))
    verdicts = judged.where("kept").select("doc_id").distinct()
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    mine = F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("mark"))
    marked = marked.withColumn("_id", mine)
    same = marked["_id"].eqNullSafe(verdicts["doc_id"])
    return marked.join(verdicts, same, "left_semi").select("row.*")
