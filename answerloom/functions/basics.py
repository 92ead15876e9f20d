"""Small column helpers shared by the other function modules."""

from functools import reduce

from pyspark.sql import Column, functions as F

# Every white-space character, of which Spark's trim() would only remove the blank.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# A number in decimal notation, and white space around it.
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
BLANKS = f"[{WHITESPACE}]*"


def strip(text: Column) -> Column:
    """Trim all leading and trailing white space, not just blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def to_double(text: Column) -> Column:
    """Decimal notation to DOUBLE; anything else (NaN, '1d', '') to NULL."""
    return F.regexp_extract(text, rf"\A{BLANKS}({NUMBER}){BLANKS}\z", 1).try_cast("double")


def case_map(subject: Column, mapping: dict, default=None) -> Column:
    """A small fixed mapping as one CASE expression."""
    first, *rest = mapping.items()
    chain = F.when(subject == F.lit(first[0]), F.lit(first[1]))
    for key, value in rest:
        chain = chain.when(subject == F.lit(key), F.lit(value))
    return chain if default is None else chain.otherwise(default)


def fail(*parts) -> Column:
    """Raise an error whose message is made of the given columns or texts."""
    columns = [
        F.coalesce(p.cast("string"), F.lit("NULL")) if isinstance(p, Column) else F.lit(p)
        for p in parts
    ]
    return F.raise_error(F.concat(*columns))


def total(columns) -> Column:
    """Sum of a list of columns."""
    return reduce(lambda a, b: a + b, columns)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
