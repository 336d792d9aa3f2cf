"""Boolean search, year, country and quality filters. Builders return one Column, so filters push down and combine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions.text import fold_null
from laurel.operators.numbering import number_rows

# Marks the export puts in place of a missing author.
NO_AUTHOR_ID = "No author id available"
NO_AUTHOR_NAME = "No author name available"


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def has_hangul(term: str) -> bool:
    return any("가" <= ch <= "힣" for ch in term)


def holds(c: Column, term: str) -> Column:
    """Substring test; case is folded unless the term is Korean. NULL text holds nothing."""
    test = c.contains(term) if has_hangul(term) else F.lower(c).contains(term.lower())
    return F.coalesce(test, F.lit(False))


def holds_exactly(c: Column, term: str) -> Column:
    return F.coalesce(c.contains(term), F.lit(False))


def keyword_filter(c: Column, all_of: Sequence[str] = (), any_of: Sequence[str] = (), none_of: Sequence[str] = ()):
    """All of `all_of` (if there are none: any of `any_of`) and none of `none_of`, as substrings."""
    main = _all([holds_exactly(c, t) for t in all_of]) if all_of else (
        _any([holds_exactly(c, t) for t in any_of]) if any_of else F.lit(True))
    return main & ~_any([holds_exactly(c, t) for t in none_of])


def every_term(texts: Sequence[Column], terms: Sequence[str]) -> Column:
    """Every term occurs in some text of the record. The texts are folded once for all terms."""
    if not terms:
        return F.lit(True)
    return _folded_once(list(texts), lambda plain, low: _all(
        [_any([_holds_in(p, f, term) for p, f in zip(plain, low, strict=True)]) for term in terms]))


def _holds_in(plain: Column, low: Column, term: str) -> Column:
    return F.coalesce(plain.contains(term) if has_hangul(term) else low.contains(term.lower()), F.lit(False))


def _folded_once(texts: list[Column], test) -> Column:
    """`test(texts, folded texts)` inside one lambda, whose argument is evaluated once per record."""
    both = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(texts)], *[F.lower(t).alias(f"l{i}") for i, t in enumerate(texts)])
    n = range(len(texts))
    return F.exists(F.array(both), lambda x: test([x[f"t{i}"] for i in n], [x[f"l{i}"] for i in n]))


def no_term(texts: Sequence[Column], terms: Sequence[str]) -> Column:
    """No term occurs in any text of the record (case-sensitive)."""
    return ~_any([holds_exactly(t, term) for t in texts for term in terms])


def title_abstract_keyword(texts: Sequence[Column], all_of: Sequence[str] = (), any_of: Sequence[str] = (),
                           none_of: Sequence[str] = ()) -> Column:
    """Search over title, abstract and keywords together. The word `and` among the AND terms is skipped.

    Without a term to look for, `none_of` alone decides; a search for `and` alone finds nothing.
    """
    wanted = [t for t in all_of if t.lower() != "and"]

    def test(plain: list[Column], low: list[Column]) -> Column:
        found = lambda t: _holds_in(plain[0], low[0], t)
        main = _all([found(t) for t in wanted]) if wanted else (
            _any([found(t) for t in any_of]) if any_of else F.lit(not all_of))
        return main & ~_any([found(t) for t in none_of])

    return _folded_once([F.concat_ws(" ", *texts)], test)


def topic_search(texts: Sequence[Column], terms: Sequence[str]) -> Column:
    """First term required; of the others those marked `!` are excluded and the rest required."""
    rest = [t.replace('"', "") for t in terms[1:] if "!" not in t]
    excluded = [t.replace("!", "") for t in terms[1:] if "!" in t]
    return title_abstract_keyword(texts, [terms[0].replace('"', ""), *rest], (), excluded)


def year_range(c: Column, first: int, last: int) -> Column:
    return c.between(first, last)


def dated_within(c: Column, first: int, last: int) -> Column:
    """Year range on a date column, as a range of dates, so that it reaches the file scan."""
    return (c >= F.lit(f"{first}-01-01").cast("timestamp")) & (c < F.lit(f"{last + 1}-01-01").cast("timestamp"))


def in_country(inst: Column, country: str) -> Column:
    return F.coalesce(inst.contains(country), F.lit(False))


def known_author(author_id: Column, author: Column) -> Column:
    """Neither the id nor the name is the export's mark for a missing one."""
    return ~holds_exactly(author_id, NO_AUTHOR_ID) & ~holds_exactly(author, NO_AUTHOR_NAME)


def performed_by(agent_code: Column, code: str = "03") -> Column:
    return F.coalesce(agent_code == code, F.lit(False))


def has_author(author: Column) -> Column:
    return author.isNotNull()


def real_name(name: Column) -> Column:
    """Not a spelling of "no value" and not cut off with dots."""
    return fold_null(name).isNotNull() & ~name.contains("...")


def _up_to(order: Sequence[tuple[str, bool]]) -> Column:
    """Whether a row comes before or at the cut `_cut_<column>` in the given order (NULL sorts lowest)."""
    test = F.lit(True)
    for name, descending in reversed(order):
        mine, cut = F.col(name), F.col(f"_cut_{name}")
        lower = F.coalesce(mine < cut, mine.isNull() & cut.isNotNull())
        higher = F.coalesce(mine > cut, mine.isNotNull() & cut.isNull())
        test = (higher if descending else lower) | (mine.eqNullSafe(cut) & test)
    return test


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], cap: int) -> DataFrame:
    """The first `cap` rows per key and `is_partial`, which tells whether the key had more. NULL is a key, too.

    `order` is a total order as (column, descending). Only these columns are numbered, by a range sort that spreads a
    big key over many tasks; the records themselves are filtered against the key's last row to keep and never shuffled
    by key.
    """
    names = [n for n, _ in order]
    sort = [F.col(n).desc() if descending else F.col(n).asc() for n, descending in order]
    numbered = number_rows(df.select(*keys, *names), keys, sort, "_rn", "_of")
    cuts = numbered.where(F.col("_rn") == F.least(F.lit(cap), F.col("_of"))).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], (F.col("_of") > cap).alias("is_partial"),
        *[F.col(n).alias(f"_cut_{n}") for n in names])
    same = _all([F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return (
        df.join(cuts, same).where(~F.col("is_partial") | _up_to(order))
        .drop(*[f"_cut_{n}" for n in names], *[f"_key_{k}" for k in keys])
    )


def rarest_term(df: DataFrame, keys: Sequence[str], fields: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Per key the hits of every term summed over the fields, and the term with the fewest (ties: listed first)."""
    lowered = df.select(*keys, *fields, *[F.lower(f).alias(f"_low_{f}") for f in fields])

    def found(field: str, term: str) -> Column:
        text, word = (field, term) if has_hangul(term) else (f"_low_{field}", term.lower())
        return F.coalesce(F.col(text).contains(word), F.lit(False)).cast("long")

    sums = [reduce(lambda a, b: a + b, [found(f, t) for f in fields]) for t in terms]
    hits = lowered.groupBy(*keys).agg(*[F.sum(s).alias(f"_t{i}") for i, s in enumerate(sums)])
    least = F.array_min(F.array(*[
        F.struct(F.col(f"_t{i}").alias("hits"), F.lit(i).alias("pos"), F.lit(t).alias("term"))
        for i, t in enumerate(terms)]))
    return hits.select(*keys, least["term"].alias("term"), least["hits"].alias("hits"))
