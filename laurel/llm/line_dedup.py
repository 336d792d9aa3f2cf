"""Line dedup: a line that many documents share stays in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.exact_dedup import normalised
from laurel.llm.tables import split_by_ids, with_ids
from laurel.session import stored

BLANKS = " \t\n\x0b\f\r"
KEY = ["key_a", "key_b"]  # 128 bits of a key's hash


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, text, print): `print` tells apart texts that share an id, so that the id need not be unique."""
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[doc_id].alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("print"))


def keyed_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, print, pos, key_a, key_b) of every line whose key has `min_chars` code points or more."""
    lines = rows.select("doc_id", "print", F.posexplode(F.split(normalised("text"), "\n")).alias("pos", "line"))
    keys = lines.withColumn("key", F.btrim("line", F.lit(BLANKS))).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "print", "pos", F.xxhash64("key").alias(KEY[0]), F.xxhash64(F.lit(1), "key").alias(KEY[1]))


def _kept(lines: Column, gone: Column) -> Column:
    """The lines but those at the positions `gone`, joined. Linear in the lines; the outer transform splits them once."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.get(F.transform(F.array(lines), lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n")), F.lit(0))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text (what is kept), n_lines (before), n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. A key of at least
    `min_chars` code points that at least `min_docs` documents hold loses all its lines, except those of the largest
    doc_id that holds it. Lines are exploded and hashed to 128 bits; distinct documents are counted per hash (first
    per document and hash, so a line that a third of all rows hold spreads over the tasks); positions to drop go back to
    their texts. Texts without such a position are not shuffled: a bitmap of fixed size tells which these are.

    Null text is empty, and an empty text is one empty line. Rows that share an id are one document when documents are
    counted, and all of them keep the lines of a key whose largest id is theirs; each is rebuilt alone. Rows without id
    count as no document and lose every shared line. Repeated rows stay. Very long texts are rebuilt in linear time, in
    one task each. There are no ties, as a key has one largest id. Further columns are ignored; no rows give no rows.
    """
    rows = _rows(docs, text, doc_id)
    lines = keyed_lines(rows, min_chars)
    shared = stored(lines.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
                    .where(F.col("n_docs") >= min_docs).select(*KEY, "keeper"), "shared_lines")
    places = (with_ids(lines, shared.select(KEY[0]), KEY[0]).join(shared, KEY)
              .where(~F.col("doc_id").eqNullSafe(F.col("keeper"))))
    gone = stored(places.groupBy("doc_id", "print").agg(F.collect_set("pos").alias("gone")), "dropped_lines")
    may, rest = split_by_ids(rows, gone.select("doc_id"))
    dropped = gone.select(F.col("doc_id").alias("own_id"), F.col("print").alias("own_print"), "gone")
    marked = may.join(dropped, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("print") == F.col("own_print")), "left")
    parts = F.split("text", "\n")
    found = marked.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_kept(parts, F.col("gone"))).alias("text"),
        F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return found.union(rest.select("doc_id", "text", F.size(parts).cast("long"), F.lit(0).cast("long")))
