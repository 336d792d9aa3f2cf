"""Facts to scores: the batch job behind a finished query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.functions import text as X
from laurel.operators import factors as A
from laurel.operators.relevance import with_relevance
from laurel.session import stored

PAPER_TEXTS = ["title", "english_title", "paper_keyword", "abstract", "english_abstract"]
PROJECT_TEXTS = ["koTitle", "enTitle", "koKeyword", "enKeyword"]


def paper_records(raw: DataFrame) -> DataFrame:
    """Stored paper records as the scoring reads them: year and citation as numbers."""
    return raw.withColumnRenamed("id", "paper_id").withColumn("issue_year", X.year_of(F.col("issue_year"))).withColumn(
        "citation", X.whole_number(F.col("citation").cast("string")))


def project_records(raw: DataFrame) -> DataFrame:
    """Stored project records: year of the end, else of the start, else 2000; manager and fund."""
    return raw.select(
        "key_id", F.col("id").alias("paper_id"), F.col("mngId").alias("manager_id"), F.col("totalFund").alias("total_fund"),
        X.year_of(X.fold_null(F.col("prdEnd")), X.fold_null(F.col("prdStart"))).alias("issue_year"), *PROJECT_TEXTS)


def ungated_factors(
    author_paper: DataFrame,
    records: DataFrame,
    profile: A.Profile,
    as_of: int,
    impact: DataFrame | None = None,
    queries: DataFrame | None = None,
    strict: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Factor rows before the contribution gate. `tasks` share the join of listings and records."""
    if impact is not None:
        records = A.with_impact(records, impact)
    if queries is not None:
        wanted = PROJECT_TEXTS if profile.by_manager else PAPER_TEXTS
        records = with_relevance(records, queries, [c for c in wanted if c in records.columns], strict)
    values = A.record_values(records, profile)
    yearly = A.yearly_sums(A.author_records(author_paper, values, profile.by_manager, tasks))
    return A.raw_factors(yearly, as_of, profile.by_manager)


def scored(raw: DataFrame, with_coop: bool = True) -> DataFrame:
    """Gated and normalised factor rows.

    The ungated rows are stored first: the maxima and the rows both read them, and a second evaluation would repeat
    the join of all author listings.
    """
    kept = stored(raw, "factors")
    return A.normalised(A.gated(kept), A.maxima(kept), with_coop)


def expert_factors(author_paper, records, profile, as_of, impact=None, queries=None, strict=False, tasks=None) -> DataFrame:
    """Normalised factor rows, one per (key_id, a_id)."""
    raw = ungated_factors(author_paper, records, profile, as_of, impact, queries, strict, tasks)
    return scored(raw, with_coop=not profile.by_manager)
