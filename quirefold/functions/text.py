"""Scalar text functions of the document engine, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and punctuation (ASCII).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def tokens(text: Column) -> Column:
    """White-space separated tokens, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def flag(condition: Column) -> Column:
    """A condition as the integer 0 or 1 of a model feature; null counts as 0."""
    return F.when(condition, 1).otherwise(0)


def contains_number_token(text: Column) -> Column:
    """A number with blanks or the text's ends around it."""
    return flag(text.rlike(r"(\s|^)[0-9]+(\s|$)"))


def starts_numbered(text: Column) -> Column:
    """Digits first, and a word after white space on the same line."""
    return flag(text.rlike(r"(?U)^[0-9]+.*?\s\w"))


def contains_tab(text: Column) -> Column:
    return flag(text.contains("\t"))


def contains_word(text: Column, *words: str) -> Column:
    low, found = F.lower(text), F.lit(False)
    for w in words:
        found = found | low.contains(w)
    return flag(found)


# Patterns of section numbers and page numbers.
PREFIX = r"^([0-9]+\.*[0-9]*\.*[0-9]*)"
PAGE_NUMBER = r"(\t[0-9]+)$"


def split_prefix(text: Column) -> tuple[Column, Column]:
    """Section number at the start, and the rest."""
    prefix = F.regexp_extract(text, PREFIX, 1)
    return prefix, F.substring(text, F.length(prefix) + 1, F.length(text))


def split_page_number(text: Column) -> tuple[Column, Column]:
    """Text without, and the page number with its tab at, the end."""
    page = F.regexp_extract(text, PAGE_NUMBER, 1)
    return F.substring(text, F.lit(1), F.length(text) - F.length(page)), page


def coded_number(text: Column, remove_words: bool = True) -> Column:
    """Section numbers as words: each dot-separated segment with a digit other than 0 becomes `cyfra` and its rank.

    The code stands where the segment's first such digit was; other characters are dropped or kept."""
    segments = F.split(text, r"\.")
    marked = F.transform(segments, lambda s, i: F.struct(s.alias("s"), s.rlike("[1-9]").alias("has"), i.alias("i")))

    def coded(x: Column) -> Column:
        rank = F.size(F.filter(marked, lambda y: y["has"] & (y["i"] <= x["i"])))
        other = lambda c: F.lit("") if remove_words else F.regexp_replace(c, "[0-9]", "")
        before, after = F.regexp_extract(x["s"], "(?s)^([^1-9]*)", 1), F.regexp_extract(x["s"], "(?s)^[^1-9]*(.*)$", 1)
        return F.when(x["has"], F.concat(other(before), F.lit(" cyfra"), rank.cast("string"), F.lit(" "), other(after))).otherwise(other(x["s"]))

    return F.array_join(F.transform(marked, coded), " punkt ")


def token_shapes(text: Column, literal_small: bool = False) -> Column:
    """Each token's shape, a blank after each: numbers by size, months, page, appendix, words, anything else."""
    parts = F.split(F.regexp_replace(F.lower(text), PUNCTUATION, " "), " ")

    def shape(t: Column) -> Column:
        s = F.regexp_replace(t, "^\t+|\t+$", "")
        core = F.when(t.startswith("\t"), s).otherwise(t)
        kind = (
            F.when(core.rlike("^[0-9][0-9]?$"), core if literal_small else F.lit("smallNum"))
            .when(core.rlike("^[0-9]{3}$"), F.lit("mediumNum"))
            .when(core.rlike("^[0-9]+$"), F.lit("bigNum"))
            .when(core.isin(*MONTHS), F.lit("month"))
            .when(core == "page", F.lit("page"))
            .when(core == "appendix", F.lit("appendix"))
            .when(core.rlike("^[a-z]+$"), F.lit("word"))
            .when(~core.rlike(r"^\s*$"), F.lit("mix"))
        )
        tab = F.when(t.startswith("\t"), F.lit("tab ")).otherwise(F.lit(""))
        return F.concat(tab, F.coalesce(F.concat(kind, F.lit(" ")), F.lit("")))  # the kind is looked for once

    return F.array_join(F.transform(parts, shape), "")


def number_words(text: Column) -> Column:
    """Tokens that begin with a digit become one word; the others stay, single blanks between."""
    return F.array_join(F.transform(tokens(text), lambda t: F.when(t.rlike("^[0-9]"), "smallNum").otherwise(t)), " ")


def normalized_header(text: Column) -> Column:
    """Lower case, no punctuation, no blanks around, no line ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), PUNCTUATION, "")), "\n", "")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def site_name_class(value: Column) -> Column:
    """Class of a table cell as a site's name. A null is like an empty cell."""
    low = F.lower(value)
    return F.when(value.isNull(), "invalid_nan").when(~has_digit(low), "invalid_no_num").when(low.contains("unnamed"), "invalid_nan").otherwise("valid")


def location_class(value: Column) -> Column:
    """Class of a table cell as a coordinate: numbers with compass letters and a grid's name are fine."""
    low = F.trim(F.lower(value))
    left = F.regexp_replace(F.regexp_replace(low, "amg", ""), "[snewm]", "")
    return F.when(value.isNull() | (low == ""), "invalid_nan").when(left.rlike(r"\p{Ll}"), "invalid").otherwise("valid")


def number_class(value: Column) -> Column:
    return F.when(value.isNull() | F.lower(value).rlike(r"\p{Ll}"), "invalid").otherwise("valid")


def padded_number(value: Column, width: int = 3) -> Column:
    """Zeros on the left up to the width; longer numbers stay."""
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)


# Patterns of numbered headings and of figure captions.
SUBHEADING, HEADING, FIGURE = r"(?U)^[0-9]+\.[0-9]+\s+\w+", r"(?U)^[0-9]+\.*\s+\w+", r"(Figure|FIGURE)\s\d+\.*\s*\w*"


def rule_heading(text: Column) -> Column:
    """Weak label of a contents line: 2 for a.b and a word, 1 for a number and a word, else 0."""
    return F.when(text.rlike(SUBHEADING), 2).when(text.rlike(HEADING), 1).otherwise(0)


def figure_line(text: Column) -> Column:
    return flag(text.rlike(FIGURE))


def digit_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: t.rlike("^[0-9]+$"))


def page_number(text: Column, position: Column | None = None) -> Column:
    """The only all-digit token; with several, the token at a predicted position from the end; else null."""
    digits = digit_tokens(text)
    chosen = F.try_element_at(tokens(text), -position) if position is not None else F.lit(None).cast("string")
    return F.when(F.size(digits) == 1, digits[0]).when(F.size(digits) > 1, chosen)


def file_extension(name: Column) -> Column:
    return F.try_element_at(F.split(name, r"\."), F.lit(2))
