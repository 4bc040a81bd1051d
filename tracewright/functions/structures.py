"""Columns over fitted structures: rendering, parsing, term variables, support."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def term_vars(name: Column) -> Column:
    """Numbers of the variables that a term's name uses, sorted and unique."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(name, F.lit(r"u(\d+)"), F.lit(1)), lambda x: x.cast("int"))))


def uses_terms(structure: Column, idxs: list[int]) -> Column:
    """True if any equation of the structure (array of arrays) has any of the terms."""
    return F.arrays_overlap(F.flatten(structure), F.array(*[F.lit(i) for i in idxs]))


def format_equation(eq: Column, terms: Column) -> Column:
    """du_k/dt's text: "du_1 = (0.5000)*u1 + (-1.0000)*u2" from an ordered array of (name, coef); "0" without terms."""
    body = F.transform(terms, lambda x: F.format_string("(%.4f)*%s", x["coef"], x["name"]))
    return F.concat(F.lit("du_"), eq.cast("string"), F.lit(" = "), F.when(F.size(terms) == 0, F.lit("0")).otherwise(F.concat_ws(" + ", body)))


def parse_equation(line: Column) -> Column:
    """Array of (name, coef) of one rendered line. Coefficients need a decimal point, as rendered ones have."""
    pattern = r"\((-?\d+\.\d+)\)\*([A-Za-z0-9^*()]+)"
    coefs = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
    names = F.regexp_extract_all(line, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(coefs.alias("c"), names.alias("n")), lambda x: F.struct(x["n"].alias("name"), x["c"].cast("double").alias("coef")))


def equation_number(line: Column) -> Column:
    return F.regexp_extract(line, r"^du_(\d+) =", 1).cast("int")


def gap_reason(term: Column) -> Column:
    """Why an expanded term lies outside the library, or null. Coefficients are stripped first (see core_term)."""
    trig = term.rlike(r"^(sin|cos)\(u\d+\)$")
    nvars = F.size(term_vars(term))
    return (
        F.when(~term.rlike(r"u\d+"), "constant_offset")
        .when(trig, None)
        .when(term.rlike(r"(sin|cos)\((?!u\d+\))"), "unsupported_trigonometric_argument")
        .when(term.rlike(r"[a-z]{2,}\("), "unsupported_function")
        .when(term.rlike(r"^u\d+(\^[23])?$"), None)
        .when(term.rlike(r"^u\d+(\^-?\d+)?$"), "unsupported_power")
        .when(term.rlike(r"^u\d+\*u\d+$") & (nvars == 2), None)
        .when(term.rlike(r"^u\d+(\^\d+)?(\*u\d+(\^\d+)?)+$") & (nvars >= 2), "mixed_higher_order_term")
        .otherwise("unsupported_product")
    )


def core_term(term: Column) -> Column:
    """The term without a numeric coefficient in front."""
    return F.regexp_replace(F.regexp_replace(term, r"\s+", ""), r"^-?\d+(\.\d+)?\*", "")


def term_stage(term: Column) -> Column:
    """Stage 1-5 of a library term, else null."""
    return (
        F.when(term.rlike(r"^u\d+$"), 1).when(term.rlike(r"^u\d+\^2$"), 2).when(term.rlike(r"^u\d+\*u\d+$") & (F.size(term_vars(term)) == 2), 3)
        .when(term.rlike(r"^u\d+\^3$"), 4).when(term.rlike(r"^(sin|cos)\(u\d+\)$"), 5)
    )
