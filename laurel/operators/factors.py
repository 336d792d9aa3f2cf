"""The factor row of every (key_id, a_id): the analytical core.

Inputs: `author_paper` (key_id, a_id, paper_id, pos, n_authors), one row per listing of an author, and `records`
(key_id, paper_id, ...). All record-level values are computed before the join, so it moves narrow rows. Everything
is then summed per (key_id, a_id, year) with map-side combine before the rows of one author meet, so an author with
a third of all records reaches the final grouping as a handful of rows, one per year.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.functions import text as X
from laurel.operators.numbering import number_rows
from laurel.session import dealt

KEY = ["key_id", "a_id"]
DEFAULT_SCORE = 0.02  # fixed value: relevance of an author none of whose texts matches

# Industrial partners whose names mark a cooperation record.
PARTNERS = [
    "Hyundai", "Kia", "Toyota", "Honda", "Nissan", "General Motors", "Chevrolet", "Ford motor", "Volkswagen", "Audi",
    "BMW", "Bayerische Motoren Werke", "Mercedes-Benz", "daimler", "Volvo", "Renault", "Jaguar", "Acura", "Mazda",
    "Subaru", "Suzuki", "Isuzu", "Daihatsu", "Peugeot", "Mclaren", "Bugatti", "Rolls Royce", "Bentley",
    "Aston Martin", "Land Rover", "Lotus", "Lexus", "Infiniti", "Datson", "Mitsubishi", "Mitsuoka", "Great Wall",
    "Cadillac", "Tesla", "Jeep", "Dodge", "Chrysler", "Porsche", "Opel", "Borgward", "Gumfut", "FIAT", "Ferrari",
    "Lamborghini", "Maserati",
]


# ---- record-level values ------------------------------------------------------------------------------------------

def with_impact(records: DataFrame, impact: DataFrame, journal: str = "issue_inst") -> DataFrame:
    """Adds `jif`: Korean records look in the `kor` table, all others in the `eng` one; missing gives 0.

    `journal` names the column to look up. A journal listed twice counts once (its largest value), so a record never
    multiplies.
    """
    lookup = impact.groupBy(F.col("lang").alias("_lang"), F.col("name").alias("_name")).agg(F.max("jif").alias("_jif"))
    lang = F.when(F.col("issue_lang") == "kor", "kor").otherwise("eng")
    return (
        records.join(lookup, (lang == F.col("_lang")) & (F.col(journal) == F.col("_name")), "left")
        .withColumn("jif", F.coalesce("_jif", F.lit(0.0)))
        .drop("_lang", "_name", "_jif")
    )


def paper_quality() -> Column:
    weight = F.when(F.col("issue_lang") == "kor", 1).otherwise(3)
    return F.log((F.coalesce("citation", F.lit(0)) * weight + 1) * (F.col("jif") + 1.1))


def paper_quality_with_usage() -> Column:
    usage = F.when(F.coalesce("usage_count", F.lit(0)) == 0, 1).otherwise(F.col("usage_count"))
    return paper_quality() + F.log(usage)


def project_quality() -> Column:
    return F.log1p(X.whole_number(F.col("total_fund")).cast("double"))


def partner_hit(inst: Column, partners: list[str]) -> Column:
    """1 when the institution string holds any partner name (case-sensitive), else 0."""
    pattern = "|".join("\\Q" + p + "\\E" for p in partners)
    return F.coalesce(inst.rlike(pattern).cast("int"), F.lit(0))


def recency_points(year: Column, as_of: int) -> Column:
    """100 up to two years back, then 10 less per year, 0 from fifteen years back.

    Hundredths as integers, so the mean does not depend on the order of summation.
    """
    faded = F.greatest(F.lit(100) - (F.lit(as_of - 3) - year) * 10, F.lit(0))
    return F.when(year >= as_of - 2, 100).when(year > as_of - 15, faded).otherwise(0)


def recentness(points: Column, n: Column) -> Column:
    """Mean of the points as a share of 1."""
    return points / (n * 100)


# ---- contribution points of one listing ---------------------------------------------------------------------------

def position_points() -> Column:
    """First author 1, last author 3, else share of the position; a sole author is a first author."""
    return (
        F.when(F.col("pos") == 0, 1.0)
        .when(F.col("pos") == F.col("n_authors") - 1, 3.0)
        .otherwise((F.col("pos") + 1) / F.col("n_authors"))
    )


# ---- profiles -----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Profile:
    """Factor definitions of a kind of site. Each is a Column over one (author, record) row."""

    quality: Column | None = None
    coop: Column | None = None
    by_manager: bool = False
    partners: list[str] = field(default_factory=lambda: PARTNERS)


def paper_profile(partners: list[str] | None = None) -> Profile:
    names = PARTNERS if partners is None else partners
    return Profile(paper_quality(), partner_hit(F.col("author_inst"), names))


def usage_profile(partners: list[str] | None = None) -> Profile:
    names = PARTNERS if partners is None else partners
    return Profile(paper_quality_with_usage(), partner_hit(F.col("author_inst"), names))


def project_profile() -> Profile:
    return Profile(project_quality(), F.lit(0), by_manager=True)


def profile_of(site: str) -> Profile:
    """NTIS delivers projects, WOS papers with usage counts, the others papers."""
    return {"NTIS": project_profile, "WOS": usage_profile}.get(site, paper_profile)()


# ---- aggregation --------------------------------------------------------------------------------------------------

def record_values(records: DataFrame, profile: Profile) -> DataFrame:
    """The narrow record side of the join."""
    score = F.col("relevance") if "relevance" in records.columns else F.lit(None).cast("double")
    manager = F.col("manager_id") if profile.by_manager else F.lit(None).cast("string")
    return records.select(
        "key_id", "paper_id", F.col("issue_year").alias("year"), profile.quality.alias("quality"),
        profile.coop.alias("coop"), score.alias("relevance"), manager.alias("manager_id"),
    )


def author_records(author_paper: DataFrame, values: DataFrame, by_manager: bool = False,
                   tasks: int | None = None) -> DataFrame:
    """One row per author and record. A record listed twice for an author counts once, its points add up.

    The grouping starts with the join keys, so a shuffled join and the grouping share one exchange. Nearly every listing
    is a group of its own, so a task holds all its listings: `tasks` says how many tasks share them (`session.tasks_for`).
    """
    of_record = ["key_id", "paper_id"]
    author_paper, values = (dealt(df, tasks, *of_record) for df in (author_paper, values))
    points = F.lit(0.0) if by_manager else F.sum(position_points())
    return (
        author_paper.join(values, of_record, "left")
        .groupBy(*of_record, "a_id")
        .agg(
            F.count("*").alias("listed"),
            points.alias("points"),
            *[F.max(c).alias(c) for c in ("year", "quality", "coop", "relevance", "manager_id")],
        )
    )


def yearly_sums(author_record: DataFrame) -> DataFrame:
    """Partial sums per author and year. Records that were not found have year NULL."""
    found = F.col("year").isNotNull()
    managed = F.col("manager_id") == F.col("a_id").cast("string")
    return author_record.groupBy(*KEY, "year").agg(
        F.sum("listed").alias("listed"),
        F.count_if(found).alias("found"),
        F.sum(F.when(found, F.col("points"))).alias("points"),
        F.count_if(found & managed).alias("managed"),
        F.count_if(found & ~managed).alias("assisted"),
        F.sum("quality").alias("quality"),
        F.sum("coop").alias("coop"),
        F.max("relevance").alias("relevance"),
    )


def longest_run(yearly: DataFrame) -> DataFrame:
    """Longest run of consecutive years per author. One row per author and year comes in, so groups stay small."""
    w = Window.partitionBy(*KEY).orderBy("year")
    return (
        yearly.where(F.col("year").isNotNull())
        .withColumn("island", F.col("year") - F.row_number().over(w))
        .groupBy(*KEY, "island").agg(F.count("*").alias("run"))
        .groupBy(*KEY).agg(F.max("run").alias("run"))
    )


def raw_factors(yearly: DataFrame, as_of: int, by_manager: bool = False) -> DataFrame:
    """Ungated factors per author. Authors without any found record are dropped."""
    w = Window.partitionBy(*KEY).orderBy("year")
    # Listings without a record (year NULL) sort first, so the difference is constant within a run of real years.
    islands = yearly.withColumn("island", F.col("year") - F.row_number().over(w))
    runs = islands.withColumn("run", F.count("year").over(Window.partitionBy(*KEY, "island")))
    contrib = (
        F.when(F.sum("managed") > 0, F.sum("managed") * 10.0 + F.sum("assisted")).otherwise(0.0)
        if by_manager else F.sum("points")
    )
    return (
        runs.groupBy(*KEY)
        .agg(
            F.sum("listed").alias("productivity"),
            F.sum("found").alias("n_found"),
            contrib.alias("contrib"),
            F.sum(recency_points(F.col("year"), as_of) * F.col("found")).alias("_recent"),
            (F.max("year") - F.min("year") + 1).alias("career"),
            F.max("run").alias("longest_run"),
            F.sum("coop").alias("coop"),
            F.sum("quality").alias("quality"),
            F.max("relevance").alias("relevance"),
        )
        .where(F.col("n_found") > 0)
        .withColumn("recentness", recentness(F.col("_recent"), F.col("n_found")))
        .withColumn("durability", F.col("longest_run") / F.col("career"))
        .drop("_recent", "n_found")
    )


def contribution_bit(contrib: Column) -> Column:
    return F.when(contrib > 0, 1).otherwise(0)


def gated(raw: DataFrame) -> DataFrame:
    """The stored factor row: five factors count only for authors with a contribution; Contrib and Acc stay."""
    bit = contribution_bit(F.col("contrib"))
    return raw.select(
        *KEY,
        (F.col("productivity") * bit).alias("productivity"),
        F.col("contrib"),
        (F.col("durability") * bit).alias("durability"),
        (F.col("recentness") * bit).alias("recentness"),
        (F.col("coop") * bit).alias("coop"),
        (F.col("quality") * bit).alias("quality"),
        F.when(bit == 0, 0.0).otherwise(F.coalesce("relevance", F.lit(DEFAULT_SCORE))).alias("acc"),
        F.col("productivity").alias("numpaper"),
    )


def maxima(raw: DataFrame) -> DataFrame:
    """Per-query maxima of the ungated factors, not below -1; a cooperation maximum of 0 counts as 1."""
    top_coop = F.greatest(F.max("coop"), F.lit(-1))
    return raw.groupBy("key_id").agg(
        F.greatest(F.max("quality"), F.lit(-1.0)).alias("max_quality"),
        F.greatest(F.max("productivity"), F.lit(-1)).alias("max_productivity"),
        F.greatest(F.max("contrib"), F.lit(-1.0)).alias("max_contrib"),
        F.when(top_coop == 0, 1).otherwise(top_coop).alias("max_coop"),
    )


def normalised(factors: DataFrame, tops: DataFrame, with_coop: bool = True) -> DataFrame:
    """Quality, Productivity, Contrib (and Coop) divided by the query's maximum; a maximum of 0 gives 0."""
    names = ["quality", "productivity", "contrib"] + (["coop"] if with_coop else [])
    scaled = {n: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(f"max_{n}")), F.lit(0.0)) for n in names}
    joined = factors.join(tops, "key_id")
    return joined.select(*[scaled.get(c, F.col(c)).alias(c) for c in factors.columns])


def min_max_scaled(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """(x - min) / (max - min) within keys; the minimum itself becomes the default score."""
    ends = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.try_divide((F.col(column) - F.col("_lo")).cast("double"), F.col("_hi") - F.col("_lo"))
    return (
        df.join(ends, keys)
        .withColumn(name, F.when(F.col(column) == F.col("_lo"), DEFAULT_SCORE).otherwise(scaled))
        .drop("_lo", "_hi")
    )


def paper_lists(author_paper: DataFrame, size: int = 1000) -> DataFrame:
    """Paper ids per author in order of arrival (`seq`, then paper_id), in parts of at most `size`.

    No author's list has to fit one row: authors of up to `size` papers are grouped at once, the papers of the others
    are numbered by a range sort first.
    """
    rows = author_paper.select(*KEY, "seq", "paper_id")
    sized = rows.join(rows.groupBy(*KEY).agg(F.count("*").alias("_all")), KEY)
    listed = F.sort_array(F.collect_list(F.struct("seq", "paper_id")))
    grouped = [F.count("*").alias("n_papers"), listed["paper_id"].alias("papers")]
    # Grouped before the union: the join has brought an author's rows together already.
    few = sized.where(F.col("_all") <= size).groupBy(*KEY).agg(*grouped)
    many = number_rows(sized.where(F.col("_all") > size).select(*KEY, "seq", "paper_id"), KEY,
                       [F.col("seq"), F.col("paper_id")], "_rn")
    parts = many.withColumn("part", F.floor((F.col("_rn") - 1) / size)).groupBy(*KEY, "part").agg(*grouped)
    return few.withColumn("part", F.lit(0).cast("long")).select(*parts.columns).union(parts)


def query_counts(records: DataFrame, author_paper: DataFrame) -> DataFrame:
    """Raw records and experts per query."""
    data = records.groupBy("key_id").agg(F.count("*").alias("data"))
    experts = author_paper.select(*KEY).distinct().groupBy("key_id").agg(F.count("*").alias("experts"))
    return data.join(experts, "key_id", "full").select(
        "key_id", F.coalesce("data", F.lit(0)).alias("data"), F.coalesce("experts", F.lit(0)).alias("experts"))
