"""Scalar functions on strings and numbers. Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "no value" in provider data.
NULL_SPELLINGS = ["", "None", "null", "없음"]
# Fixed value: characters removed by `drop_symbols`.
SYMBOLS = "-=.#/?:$}()"


def fold_null(c: Column) -> Column:
    """NULL for every spelling of "no value"."""
    return F.when(~c.isin(NULL_SPELLINGS), c)


def strip_markup(c: Column) -> Column:
    """Tags and hyphens removed."""
    return F.regexp_replace(c, r"<[^\n]*?>|-", "")


def strip_tags(c: Column) -> Column:
    """Non-empty tags removed."""
    return F.regexp_replace(c, r"<[^\n]+?>", "")


def strip_highlight(c: Column, leading_space: bool = False) -> Column:
    """Search-highlight markup removed; `leading_space` also takes the blank before it."""
    opening = "<span class=\\search_word\\>"
    return F.replace(F.replace(c, F.lit(" " + opening if leading_space else opening), F.lit("")),
                     F.lit("</span>"), F.lit(""))


def has_hangul(c: Column) -> Column:
    return c.rlike("[가-힣]")


def language(c: Column) -> Column:
    """`kor` when the text holds any Hangul syllable, else `eng`."""
    return F.when(has_hangul(c), "kor").otherwise("eng")


def title_in(c: Column, lang: str) -> Column:
    """The last title of an array that is in `lang`, else ''."""
    return F.coalesce(F.try_element_at(F.filter(c, lambda t: language(t) == lang), F.lit(-1)), F.lit(""))


def tagged_text(c: Column, *langs: str) -> Column:
    """The last text of an array of (lang, text) structs whose tag is one of `langs`, else ''."""
    hits = F.filter(c, lambda a: a["lang"].isin(list(langs)))
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["text"], F.lit(""))


def number(c: Column) -> Column:
    """A numeric cell as a whole number, also where an export writes it as `123.0`; NULL if it is no number."""
    return F.coalesce(c.try_cast("long"), F.when(c.rlike(r"^\s*-?\d+\.\d*\s*$"), F.trim(F.split_part(
        c, F.lit("."), F.lit(1))).try_cast("long")))


def digits_of(c: Column) -> Column:
    """The digits of a string as text without leading zeros, of any length; nothing left gives `0`."""
    digits = F.ltrim(F.regexp_replace(c, r"\D", ""), F.lit("0"))
    return F.when(digits == "", "0").otherwise(digits)


def digits_only(c: Column) -> Column:
    """The digits of a string as a number; nothing left, or no string, gives 0, more than a long holds NULL (see `digits_of`)."""
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(digits_of(c).try_cast("long"))


def page_number(c: Column) -> Column:
    """A page as a number: a numeric cell, else the digits of the text."""
    return F.coalesce(number(c), digits_only(c))


def page_range(c: Column) -> Column:
    """`pp.a-b` as struct(start, end): the first three characters dropped, split at the first hyphen."""
    dash = F.instr(c, "-")
    return F.struct(
        F.when(dash > 0, F.substring(c, F.lit(4), F.greatest(dash - 4, F.lit(0))))
        .otherwise(F.substr(c, F.lit(4))).alias("start"),
        F.when(dash > 0, F.substr(c, dash + 1)).otherwise(F.lit("")).alias("end"),
    )


def digit_run(c: Column, n: int) -> Column:
    """The n-th run of digits (from 0) as a number, else 0; more than a long holds is NULL."""
    return digits_only(F.get(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), F.lit(n)))


def joined_digit_runs(c: Column) -> Column:
    """All runs of digits joined by `,`: the id in a profile address."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), ",")


def node_id(c: Column) -> Column:
    """The `NODE…` record id in a link."""
    return F.concat(F.lit("NODE"), F.split_part(c, F.lit("NODE"), F.lit(2)))


def drop_text(c: Column, text: str) -> Column:
    return F.replace(c, F.lit(text), F.lit(""))


def drop_affiliation_codes(c: Column) -> Column:
    return F.regexp_replace(c, "[A-Z]{2}[0-9]{7}", "")


def registry_name(c: Column) -> Column:
    return F.when(c.contains("KCI"), "KCI").otherwise(c)


def drop_last_symbol(c: Column) -> Column:
    """One trailing character that is neither letter nor digit removed."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]\z", "")


def year_of(*candidates: Column, default: int = 2000) -> Column:
    """The first candidate whose first four characters are a year, else `default`."""
    return F.coalesce(*[F.left(c.cast("string"), F.lit(4)).try_cast("int") for c in candidates], F.lit(default))


def export_year(year: Column, early_access: Column) -> Column:
    """Year column, else the early-access column as a number, else its digits."""
    digits = F.regexp_replace(early_access, r"\D", "")
    return F.coalesce(number(year), number(early_access), digits.try_cast("long"))


def whole_number(c: Column, default: int = 0) -> Column:
    return F.coalesce(number(c), F.lit(default).cast("long"))


def person_id(c: Column) -> Column:
    """Quotes removed, then the prefix up to the first dot."""
    return F.regexp_replace(F.replace(c, F.lit('"'), F.lit("")), r"^[^.]*\.", "")


def grouped_number(c: Column) -> Column:
    """`12,345` as a number."""
    return number(F.replace(c, F.lit(","), F.lit("")))


def drop_symbols(c: Column, min_length: int) -> Column:
    """Array of strings without `SYMBOLS`, keeping those with at least `min_length` characters."""
    pattern = "[" + "".join("\\" + ch for ch in SYMBOLS) + "]"
    cleaned = F.transform(c, lambda s: F.regexp_replace(s, pattern, ""))
    return F.filter(cleaned, lambda s: (s != "") & (s != "None") & (F.length(s) >= min_length))


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def clean_query(c: Column) -> Column:
    """The group marks `|` and `!` removed; the words stay."""
    return F.regexp_replace(c, "[|!]", "")
