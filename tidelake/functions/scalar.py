"""Cleaning, typing and arithmetic on columns. Every function is Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters a cleaned string may not start or end with.
WHITESPACE = " \t\n\x0b\f\r"

# Accepted spellings of a consent flag.
CONSENT_TRUE = ("true", "yes", "1")
CONSENT_FALSE = ("false", "no", "0")

MONEY = "decimal(18,2)"

FULL_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T]|$)"
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_string(value: Column | str) -> Column:
    """Text without outer whitespace; blank becomes NULL."""
    return F.nullif(F.btrim(_col(value).cast("string"), F.lit(WHITESPACE)), F.lit(""))


def parse_timestamp(value: Column | str) -> Column:
    """Cleaned text to a UTC timestamp; text that does not begin with a full date is NULL."""
    return _timestamp(clean_string(value))


def _timestamp(text: Column) -> Column:
    return F.when(text.rlike(FULL_DATE), text.try_cast("timestamp"))


def to_number(value: Column | str, dtype: str) -> Column:
    """Cleaned text to ``dtype``; what is not a plain finite decimal number becomes NULL."""
    text = clean_string(value)
    number = F.when(text.rlike(DECIMAL), text.try_cast(dtype))
    if dtype in ("double", "float"):
        return F.when(F.abs(number) < F.lit(float("inf")), number)
    return number


def consent(value: Column | str) -> Column:
    """Consent text to a boolean; any other spelling becomes NULL."""
    return _consent(clean_string(value))


def _consent(cleaned: Column) -> Column:
    text = F.lower(cleaned)
    return (
        F.when(text.isin(*CONSENT_TRUE), F.lit(True))
        .when(text.isin(*CONSENT_FALSE), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def fractional_days_between(start: Column | str, end: Column | str) -> Column:
    """Whole elapsed seconds over 86400, with sign."""
    seconds = F.timestamp_diff("SECOND", _col(start), _col(end))
    return seconds.cast("double") / F.lit(86400.0)


def utc_text(value: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss+00:00``; NULL stays NULL."""
    return F.concat(F.date_format(_col(value), "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))


def parse_iso_utc(value: Column | str) -> Column:
    """ISO-8601 text with an offset or a trailing ``Z``, as a UTC timestamp."""
    return F.try_to_timestamp(clean_string(value))


def money(value: Column | str) -> Column:
    """Exact decimal for summing: the result does not depend on row order.

    An amount beyond the type is NULL, like unreadable text, and does not end the job.
    """
    return _col(value).try_cast(MONEY)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, and 0 where the divisor is 0 or either side is NULL."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0))


def rounded_ratio(numerator: Column, denominator: Column, places: int = 2) -> Column:
    """Half-up quotient of two amounts with at most two decimals, 0 for a zero divisor.

    Works on whole cents, so a tie is a tie: a decimal quotient cut to a fixed scale and
    then rounded again can land on the wrong side of one.
    """
    top = (numerator * 100).cast("decimal(38,0)")
    bottom = (denominator * 100).cast("decimal(38,0)")
    twice = F.abs(top) * (2 * 10**places) + F.abs(bottom)
    units = F.call_function("div", twice, F.nullif(F.abs(bottom) * 2, F.lit(0)))
    signed = units * F.signum(top) * F.signum(bottom)
    return F.coalesce(signed.cast("double") / float(10**places), F.lit(0.0))


def rounded(value: Column, places: int = 2) -> Column:
    """Half-up rounding on decimals, returned as double."""
    return F.round(value, places).cast("double")


def round_numeric(df, columns: dict[str, int]):
    """Round the named numeric columns half-up, each to its own number of places.

    A number beyond ``decimal(38,10)`` has no digits behind the point and stays as it is.
    """
    return df.withColumns(
        {
            name: F.coalesce(
                rounded(F.col(name).try_cast("decimal(38,10)"), k), F.col(name).cast("double")
            )
            for name, k in columns.items()
        }
    )


def identifier(value: Column | str) -> Column:
    """Path-safe identifier; NULL where nothing is left of the text."""
    token = F.regexp_replace(_col(value), "[^a-zA-Z0-9._-]+", "-")
    return F.nullif(F.btrim(token, F.lit("-")), F.lit(""))


# How the raw text of each kind is read.
READERS = {
    "string": clean_string,
    "timestamp": parse_timestamp,
    "consent": consent,
    "bigint": lambda value: to_number(value, "bigint"),
    "double": lambda value: to_number(value, "double"),
    # An amount is kept as it was read; sums take it as ``money``.
    "money": lambda value: to_number(value, "double"),
}

NUMBERS = {"bigint": "bigint", "double": "double", "money": "double"}
_TEXT_READERS = {"string": lambda text: text, "timestamp": _timestamp, "consent": _consent}


def typed_cells(df: DataFrame, kinds: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The cells of ``kinds``, numbered in its order, read as ``READERS`` reads them.

    ``_text0`` is the cleaned text, ``_cell0`` the value, and ``_plain0``, of numbers only, whether
    the text is a decimal number; the columns ``keep`` stay beside them. Each step is a select of
    its own: what several expressions mention is then worked out once and not once a mention.
    """
    cells = {str(i): kind for i, kind in enumerate(kinds.values())}
    numbers = {i: NUMBERS[kind] for i, kind in cells.items() if kind in NUMBERS}
    whole = dict(zip(cells, kinds))
    trimmed = df.select(
        *keep,
        *[F.btrim(F.col(whole[i]).cast("string"), F.lit(WHITESPACE)).alias(f"_text{i}") for i in cells],
    )
    texts = [f"_text{i}" for i in cells]
    cleaned = trimmed.select(*keep, *[F.nullif(t, F.lit("")).alias(t) for t in texts])
    tested = cleaned.select(
        "*", *[F.col(f"_text{i}").rlike(DECIMAL).alias(f"_plain{i}") for i in numbers]
    )

    def value(i: str) -> Column:
        text = F.col(f"_text{i}")
        if i in numbers:
            return F.when(F.col(f"_plain{i}"), text.try_cast(numbers[i]))
        return _TEXT_READERS[cells[i]](text)

    read = tested.select("*", *[value(i).alias(f"_cell{i}") for i in cells])
    finite = {
        f"_cell{i}": F.when(F.abs(f"_cell{i}") < F.lit(float("inf")), F.col(f"_cell{i}"))
        for i, kind in numbers.items()
        if kind == "double"
    }
    return read.withColumns(finite) if finite else read
