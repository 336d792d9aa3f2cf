"""Similarity matching of `Name/ID` entries to the authors of the same record.

One record holds its authors and its entries, so everything happens in its row: no explode, no shuffle. The Jaro
sums and the conflict rule run in an Arrow UDF, a batch of records at once; the alignment is an expression.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import fuzzy
from laurel.functions.multivalue import let


def entry_names(entries: Column) -> Column:
    """The entries with a name, as strings `Name/ID`."""
    return F.filter(F.split(F.coalesce(entries, F.lit("")), ";"),
                    lambda e: F.trim(F.split_part(e, F.lit("/"), F.lit(1))) != "")


def _people(author: str) -> Column:
    return F.filter(F.split(author, ";"), lambda a: F.trim(a) != "")


def _entry_ids(entries: str) -> Column:
    return F.transform(entry_names(F.col(entries)),
                       lambda e: F.trim(F.replace(F.split_part(e, F.lit("/"), F.lit(2)), F.lit(","), F.lit(""))))


def with_best_author(df: DataFrame, author: str, entries: str, cut: float = fuzzy.MIN_SIMILARITY) -> DataFrame:
    """Adds `people` (names), `entry_id` and `best` (author position per entry, -1 for none)."""
    return df.withColumns({"people": _people(author), "entry_id": _entry_ids(entries),
                           "best": fuzzy.best_author(F.col(entries), F.col(author), cut)})


def with_aligned_ids(df: DataFrame, author: str, entries: str, name: str) -> DataFrame:
    """Adds `name`: the ids as a `;` list aligned to the authors, blank where there is none."""
    return with_all_aligned_ids(df, author, {name: entries})


def with_all_aligned_ids(df: DataFrame, author: str, lists: Mapping[str, str]) -> DataFrame:
    """`with_aligned_ids` for several lists {name: entries}; between the UDFs nothing but their results is added to the rows."""
    matched = df.withColumns({f"_best_{name}": fuzzy.best_author(
        F.col(entries), F.col(author), conflicts=False) for name, entries in lists.items()})
    placed = lambda name: lambda entry_id: fuzzy.ids_by_position(F.col(f"_best_{name}"), _people(author), entry_id)
    ids = {name: let(_entry_ids(entries), placed(name)) for name, entries in lists.items()}
    return matched.withColumns(ids).drop(*[f"_best_{name}" for name in lists])
