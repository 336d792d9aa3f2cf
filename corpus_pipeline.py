"""The corpus pipeline: toxicity, language, exact and near duplicates, packing; each stage's rows go to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm import exact_dedup, jaccard_join, language, packing, toxicity
from laurel.llm.queries import tokenizer_file
from laurel.llm.tables import named_rows, split_by_ids, table, text_sha256, without_ids, without_rows
from laurel.operators.numbering import number_rows
from laurel.session import stored

MIN_LANGUAGE_SCORE = 0.2  # below, a text is in none of the learned languages


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows whose text the model calls toxic, not others of their id. It learns from the labels of the documents.

    Null and empty texts are scored as texts without words; rows without id are judged by their text. Repeated rows go or
    stay together. No rows give no rows, and further columns are carried along, whatever their names.
    """
    scores = toxicity.scored(named_rows(docs), toxicity.fit(docs, table(spark, sf_dir, "labels")), doc_id="row_id")
    return without_rows(docs, stored(scores.where("predicted = 1").select("doc_id.*"), "toxic"))


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows whose text is in no learned language (without letters, or far from all), not others of their id.

    So null and empty texts go, and every row if nothing can be learned. Repeated rows go or stay together. No rows give
    no rows, and further columns are carried along, whatever their names.
    """
    found = language.identified(named_rows(docs), language.fit(docs), doc_id="row_id")
    bad = found.where((F.col("lang_pred") == language.UNDETERMINED) | (F.col("score") < MIN_LANGUAGE_SCORE))
    return without_rows(docs, stored(bad.select("doc_id.*"), "undetermined"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of each text that the content sort keeps; of rows with the same id and text, one.

    Null text equals empty text, a row without id stays only if no row of its text has an id. No rows give no rows, and
    further columns are carried along, whatever their names.
    """
    found = stored(exact_dedup.content_sort(docs).select("doc_id", "text_sha256", "kept"), "copies")
    may, rest = split_by_ids(docs, found.where("not kept").select("doc_id"))
    kept = found.where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    rows = may.select(F.struct(*[may[c] for c in may.columns]).alias("row"), F.col("doc_id").alias("own_id"),
                      F.sha2(exact_dedup.normalised("text"), 256).alias("own_sha"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["own_id", "own_sha"]).select("row.*").union(rest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of every class of linked documents.

    Different texts that share an id are documents of their own; of those in one class the least SHA-256 comes first.
    Rows with the same id and text stay or go together; rows without id stay, as do null, empty and blank texts, which
    are linked with nothing. No rows give no rows, and further columns are carried along, whatever their names.
    """
    shared = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if shared.isEmpty():
        classes = jaccard_join.near_duplicate_classes(docs)
        return without_ids(docs, stored(classes.where("component_id <> doc_id").select("doc_id"), "near_copies"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), text_sha256().alias("sha"), "text")
    numbers = stored(number_rows(texts.select("id", "sha").distinct(), [], [F.col("id"), F.col("sha")], "number"), "numbers")
    classes = jaccard_join.near_duplicate_classes(texts.join(numbers, ["id", "sha"]), doc_id="number")
    gone = classes.where("component_id <> doc_id").select(F.col("doc_id").alias("number")).distinct().join(numbers, "number")
    return without_rows(docs, stored(gone.select("id", "sha"), "near_copies"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, placed in sequences (see `packing.pack` for null, empty and repeated texts).

    Further columns are left out; no rows give no rows.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity (2)", drop_toxic),
    ("language ID (9)", drop_undetermined),
    ("exact dedup (3)", drop_exact_copies),
    ("n-gram Jaccard join (6)", drop_near_copies),
    ("packing (4)", pack_sequences),
]
ORACLE_SQL = None  # the learned stages and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
