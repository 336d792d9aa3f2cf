"""Relevance (Acc) of a record's texts to its query, in closed form.

A text becomes the vector of its counts of the query's words; its score is the cosine with the all-ones vector of the
query's length, i.e. (sum tf / sqrt(sum tf^2)) / sqrt(n). A record takes its text with the best direction, an author
the best record. The score needs only the row itself, so it is an expression: one regular-expression scan per text,
of which only the query's words are kept; no explode, no shuffle, no UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import text as X

WORD = r"[\p{L}\p{N}_]{2,}"


def words_of(c: Column) -> Column:
    """Lower-cased words of two or more word characters. One constant pattern, so it is compiled once per task."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def query_plan(queries: DataFrame) -> DataFrame:
    """(key_id, query) -> (key_id, words, n_words).

    `words` is the vocabulary (distinct words), `n_words` the number of blank-separated pieces of two or more
    characters. The group marks are removed, so NOT words score, too.
    """
    query = X.clean_query(F.col("query"))
    pieces = F.filter(F.regexp_extract_all(query, F.lit(r"\S+"), F.lit(0)), lambda w: F.length(w) >= 2)
    return queries.select("key_id", F.array_distinct(words_of(query)).alias("words"), F.size(pieces).alias("n_words"))


def usable(c: Column) -> Column:
    """Texts that count: not NULL, not empty, not the word None."""
    return c.isNotNull() & ~c.isin("", "None")


def direction(texts: Column) -> Column:
    """Best sum tf / sqrt(sum tf^2) over an array of texts; 0 when nothing matches."""
    hits = F.transform(F.filter(texts, usable), lambda t: F.filter(
        words_of(t), lambda w: F.array_contains(F.col("words"), w)))

    def one(hit: Column) -> Column:
        counts = F.transform(F.col("words"), lambda w: F.size(F.filter(hit, lambda h: h == w)).cast("double"))
        return F.aggregate(
            counts,
            F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")),
            lambda acc: F.try_divide(acc["s"], F.sqrt(acc["q"])),  # NULL for a text without a hit
        )

    return F.coalesce(F.array_max(F.transform(hits, one)), F.lit(0.0))


def with_relevance(records: DataFrame, queries: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """Adds `relevance` (the score before the contribution gate) to records.

    A query whose vocabulary size differs from its word count cannot be compared by the scoring rule: any matching
    text then scores 1, unless `strict`, which compares with the vocabulary instead. A query without a vocabulary
    scores 1 for every record that has a text at all.
    """
    texts = F.array(*[F.col(c) for c in columns])
    best = F.col("_best")
    n = F.size("words")
    cosine = best / F.sqrt(F.greatest(n, F.lit(1)))
    has_text = reduce(lambda a, b: a | b, [usable(F.col(c)) for c in columns])
    matched = cosine if strict else F.when(n == F.col("n_words"), cosine).otherwise(1.0)
    no_words = F.when(has_text, F.lit(0.02 if strict else 1.0)).otherwise(0.02)
    score = F.when(n == 0, no_words).when(best > 0, matched).otherwise(0.02)
    return (
        records.join(query_plan(queries), "key_id", "left")
        .withColumn("_best", F.when(F.size("words") > 0, direction(texts)).otherwise(0.0))
        .withColumn("relevance", F.when(F.col("words").isNotNull(), score))
        .drop("words", "n_words", "_best")
    )
