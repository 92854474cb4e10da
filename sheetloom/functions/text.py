"""Numbers in recognised text, pair keys, fused readings. All are column expressions; null texts give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic-Indic digits, then extended (Persian) digits, of 0 to 9 each.
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
PERSIAN = "۰۱۲۳۴۵۶۷۸۹"
WESTERN = "0123456789"
DECIMAL_DIGITS = r"\p{Nd}"


def map_number(filename: Column) -> Column:
    """The last word of a file name without its extension."""
    stem = F.regexp_replace(F.trim(F.regexp_replace(filename, r"\.[^.]*$", "")), r"^.*/", "")
    return F.element_at(F.split(stem, r"\s+"), -1)


def to_western(text: Column, persian: bool = True) -> Column:
    return F.translate(text, ARABIC_INDIC + (PERSIAN if persian else ""), WESTERN * (2 if persian else 1))


def western_digits(text: Column) -> Column:
    """The digits of a text, Arabic-Indic and Persian ones as 0 to 9, and nothing else."""
    return F.regexp_replace(to_western(text), "[^0-9]", "")


def normalise_number(text: Column) -> Column:
    """All digits of a text as one number of 100 to 99999, else null."""
    digits = F.regexp_replace(to_western(text, persian=False), "[^0-9]", "")
    value = F.when(F.length(F.regexp_replace(digits, "^0+", "")).between(3, 5), digits.cast("long"))
    return F.when(value.between(100, 99999), value.cast("int"))


def four_digit_numbers(text: Column) -> Column:
    """Numbers of 2000 to 9999 among the digits of a text, four at a time from the left, gaps ignored."""
    parts = F.regexp_extract_all(western_digits(text), F.lit("([0-9]{4})"), F.lit(1))
    return F.filter(F.transform(parts, lambda x: x.cast("int")), lambda x: x.between(2000, 9999))


def first_number(text: Column) -> Column:
    """The first free-standing number of 2000 to 9999; null for an empty answer and one that begins with NONE."""
    western = to_western(text)
    found = F.regexp_extract(western, r"(?U)\b([2-9][0-9]{3})\b", 1)
    silent = F.upper(F.trim(text)).startswith("NONE")
    return F.when(~silent & (found != ""), found.cast("int"))


def single_number(text: Column) -> Column:
    """The digits of a text if they are exactly four, of 2000 to 3999."""
    digits = western_digits(text)
    value = F.when(F.length(digits) == 4, digits.cast("int"))
    return F.when(value.between(2000, 3999), value)


def fuse_readings(number_1: Column, conf_1: Column, number_2: Column, conf_2: Column) -> Column:
    """struct(number, confidence) of two engines' readings.

    One reading alone keeps seven tenths of its confidence; readings that agree are weighed 0.4 and 0.6; of readings that
    differ the one with the larger weighted confidence stays, at 0.56 of its confidence, the second of equals.
    """
    one = lambda n, c: F.struct(n.cast("int").alias("number"), c.cast("double").alias("confidence"))
    weighted_1, weighted_2 = 0.4 * conf_1, 0.6 * conf_2
    return (
        F.when(number_1.isNull() & number_2.isNull(), one(F.lit(None), F.lit(0.0)))
        .when(number_1.isNull(), one(number_2, conf_2 * 0.7))
        .when(number_2.isNull(), one(number_1, conf_1 * 0.7))
        .when(number_1 == number_2, one(number_1, F.least(weighted_1 + weighted_2, F.lit(1.0))))
        .when(weighted_1 > weighted_2, one(number_1, conf_1 * 0.7 * 0.8))
        .otherwise(one(number_2, conf_2 * 0.7 * 0.8))
    )


def pair_key(map_a: Column, map_b: Column) -> Column:
    return F.concat_ws("_", map_a, map_b)


def pair_sides(pair: Column) -> tuple[Column, Column]:
    parts = F.split(pair, "_")
    return parts[0], parts[1]


def token_cost(tokens_in: Column, tokens_out: Column, per_million_in: float = 1.0, per_million_out: float = 5.0) -> Column:
    return tokens_in / 1e6 * per_million_in + tokens_out / 1e6 * per_million_out
