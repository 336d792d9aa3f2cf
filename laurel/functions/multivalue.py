"""Functions on `;` lists and parallel lists. All stay in one row: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row: inside a lambda an expression would run per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def items(c: Column, sep: str = ";") -> Column:
    """A delimited string as an array of trimmed items."""
    return F.transform(F.split(c, sep), lambda x: F.trim(x))


def emit(c: Column, sep: str = ";") -> Column:
    return F.array_join(c, sep, "")


def paired(names: Column, insts: Column) -> Column:
    """Two arrays paired by position, cut to the shorter one."""
    n = F.least(F.size(names), F.size(insts))
    both = F.zip_with(names, insts, lambda a, b: F.struct(a.alias("name"), b.alias("inst")))
    return F.slice(both, F.lit(1), n)


def same_size(a: Column, b: Column) -> Column:
    return F.size(a) == F.size(b)


def both_filled(a: Column, b: Column) -> Column:
    """Equally long and not empty."""
    return (F.size(a) == F.size(b)) & (F.size(a) > 0)


def same_separator_count(a: Column, b: Column, sep: str = ";") -> Column:
    """Equal numbers of separators in two strings."""
    return F.size(F.split(a, sep)) == F.size(F.split(b, sep))


def institution_list(c: Column) -> Column:
    """Institutions of a record. If the string names KISTI, every author gets the first one, without `&lt`."""
    first = F.replace(F.split_part(c, F.lit(";"), F.lit(1)), F.lit("&lt"), F.lit(""))
    spread = F.array_repeat(F.trim(first), F.size(F.split(c, ";")))
    return F.when(c.contains("KISTI"), spread).otherwise(items(c))


def name_inst_pairs(tokens: Column) -> Column:
    """`Name(Inst)` tokens as structs. A token that is not closed by `)` is a prefix of the next one."""
    def whole(ts: Column) -> Column:
        return F.transform(ts, lambda t, i: F.when(
            t.endswith(")"),
            F.when((i > 0) & ~F.get(ts, i - 1).endswith(")"), F.concat(F.get(ts, i - 1), F.lit(" "), t))
            .otherwise(t)))

    closed = F.filter(let(tokens, whole), lambda t: t.isNotNull())
    return F.transform(closed, lambda t: F.struct(
        F.regexp_extract(t, r"^([^(]*)\(", 1).alias("name"),
        F.regexp_extract(t, r"^[^(]*\((.*)\)$", 1).alias("inst")))


def institutions_without_names(author: Column, affiliated: Column) -> Column:
    """Institutions from `Name, Inst; Name, Inst`: author-name words removed, a blank one repeats the one before."""
    names = F.split(F.replace(author, F.lit(";"), F.lit("")), " ")
    words = F.split(F.replace(F.replace(affiliated, F.lit(","), F.lit("")), F.lit(";"), F.lit(" ;")), " ")
    kept = let(names, lambda ns: F.array_join(F.filter(words, lambda w: ~F.array_contains(ns, w)), " "))

    def last_filled(parts: Column) -> Column:
        # positions of the filled parts up to each part; the last one gives the value
        places = F.aggregate(
            F.transform(parts, lambda p, i: F.when(p != "", i)),
            F.array().cast("array<int>"),
            lambda acc, i: F.array_append(acc, F.coalesce(i, F.try_element_at(acc, F.lit(-1)), F.lit(-1))))
        return F.transform(places, lambda i: F.coalesce(F.get(parts, i), F.lit("")))

    return F.when(affiliated == "", "").otherwise(F.array_join(let(items(kept), last_filled), "; "))


def bracketed_institutions(author: Column, c: Column) -> Column:
    """`[A; B] inst1; [C] inst2` as one institution per author, in author order; the first listing wins.

    NULL items mark authors without a listing. Text without brackets is split as it is.
    """
    listing = r"\[([^\]]*)\]([^\[]*)"
    places = F.transform(F.regexp_extract_all(c, F.lit(listing), F.lit(2)),
                         lambda p: F.trim(F.replace(p, F.lit(";"), F.lit(""))))
    members = F.transform(F.regexp_extract_all(c, F.lit(listing), F.lit(1)),
                          lambda m: F.split(F.replace(m, F.lit(" "), F.lit("")), ";"))
    pairs = F.flatten(F.zip_with(members, places, lambda ms, p: F.transform(
        ms, lambda m: F.struct(m.alias("name"), p.alias("inst")))))
    authors = F.split(F.replace(author, F.lit(" "), F.lit("")), ";")
    first = let(pairs, lambda ps: let(ps["name"], lambda ns: F.transform(
        authors, lambda a: F.get(ps, F.array_position(ns, a).cast("int") - 1)["inst"])))
    return F.when(c.contains("["), first).otherwise(items(c))


def comma_to_semicolon(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(";"))


def drop_final_separator(c: Column) -> Column:
    return F.regexp_replace(c, r";\z", "")
