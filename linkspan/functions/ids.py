"""Variant identifiers and the order of chromosomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last run of digits after something else.
LAST_RUN = "[^0-9]([0-9]+)[^0-9]*$"


def _is_number(ident: Column) -> Column:
    return ident.rlike("^[0-9]+$")


def id_number(ident: Column) -> Column:
    """Number in an identifier: its last run of digits as a long; all-digit identifiers are their own
    number; null if no digit follows something else (``has_number`` tells whether there is any)."""
    digits = F.when(_is_number(ident), ident).otherwise(F.regexp_extract(ident, LAST_RUN, 1))
    return digits.try_cast("bigint")


def id_template(ident: Column) -> Column:
    """Identifier with % in place of that run; all-digit identifiers are their own template."""
    run = F.regexp_extract(ident, LAST_RUN, 1)
    rest = F.regexp_extract(ident, "[^0-9]*$", 0)
    head = F.substring(ident, F.lit(1), F.length(ident) - F.length(run) - F.length(rest))
    return F.when(_is_number(ident) | (run == ""), ident).otherwise(F.concat(head, F.lit("%"), rest))


def join_id(number: Column, template: Column) -> Column:
    """Inverse: the number in place of the first %. Leading zeros are lost in the number, so tables
    here keep the identifier itself as well."""
    at = F.locate("%", template)
    whole = F.concat(F.substring(template, F.lit(1), at - 1), number.cast("string"), F.substring(template, at + 1, F.length(template)))
    return F.when(at > 0, whole).otherwise(template)


def has_number(ident: Column) -> Column:
    return ident.rlike(r"\d")


def chrom_rank(chrom: Column) -> Column:
    """Digits by value, then the others by name (MT, X, Y)."""
    plain = F.regexp_replace(chrom, "^chr", "")
    return F.when(plain.rlike(r"^\d+$"), F.lpad(plain, 9, "0")).otherwise(F.concat(F.lit("~"), plain))


def natural_key(name: Column) -> Column:
    """Sorts as version sort does: runs of digits by value (chr1_2 before chr1_10)."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 18, "0")).otherwise(p))
