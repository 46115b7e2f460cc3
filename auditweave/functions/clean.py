"""Column expressions for cleaning, shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NULL_WORDS = ("null", "none", "nil", "n/a", "na", "")
WHITE = " \t\n\x0b\f\r"  # what \s stands for
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"

ColumnLike = Column | str


def _col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: ColumnLike) -> Column:
    """Remove every kind of surrounding white space, not only blanks.

    The pattern also takes white space before one last line separator of Unicode; text that ends
    in ASCII has none and is trimmed without a pattern.
    """
    text = _col(value).cast("string")
    return F.when(F.substring(text, -1, 1) > F.lit("~"), F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(F.btrim(text, F.lit(WHITE)))


def clean_text(value: ColumnLike) -> Column:
    """Stripped text; NULL when nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def to_number(value: ColumnLike) -> Column:
    """Finite number or NULL."""
    number = _col(value).try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite, number)


def to_date(value: ColumnLike) -> Column:
    """Date or NULL; the time of day is dropped."""
    return F.try_to_timestamp(_col(value).cast("string")).cast("date")


def iso_date(value: ColumnLike) -> Column:
    """The text itself when it is a real ``YYYY-MM-DD`` day, else NULL."""
    text = strip(value)
    real = F.when(text.rlike(ISO_DATE), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).isNotNull()
    return F.when(real, text)


def normalize_status(value: ColumnLike) -> Column:
    return F.lower(strip(F.coalesce(_col(value), F.lit(""))))


def entity_prefix(prefix: str, value: ColumnLike) -> Column:
    """Put ``RFC:``/``EMP:`` in front exactly once."""
    text = strip(value)
    return F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def normalize_entity(value: ColumnLike, is_employee: bool = False) -> tuple[Column, Column]:
    """(entity, entity_error): a bad entity is reported in its row, never raised."""
    prefix, other = ("EMP:", "RFC:") if is_employee else ("RFC:", "EMP:")
    text = clean_text(value)
    payload = clean_text(F.regexp_replace(text, "^" + prefix, ""))
    error = (
        F.when(text.isNull(), F.lit("empty entity"))
        .when(text.startswith(other), F.lit("wrong prefix"))
        .when(payload.isNull(), F.lit("empty payload"))
        .when(payload.rlike(r"\s"), F.lit("white space in entity"))
    )
    return F.when(error.isNull(), entity_prefix(prefix, text)), error


def observation_id(family: str, prefix: str, parts: Sequence[ColumnLike]) -> Column:
    """``OBS-<family>-<prefix>-`` and twelve hex digits of SHA-1 over the parts."""
    joined = F.concat_ws("|", *[_col(part).cast("string") for part in parts])
    return F.concat(F.lit(f"OBS-{family}-{prefix}-"), F.upper(F.substring(F.sha1(joined), 1, 12)))


def null_like(value: ColumnLike) -> Column:
    """Words people use for "nothing" become NULL; other text is kept as it is."""
    return F.when(~F.lower(strip(value)).isin(*NULL_WORDS), _col(value))


def clip(value: ColumnLike, limit: int) -> Column:
    text = strip(value)
    short = F.concat(F.regexp_replace(F.substring(text, 1, limit - 3), r"\s+$", ""), F.lit("..."))
    return F.when(F.length(text) > limit, short).otherwise(text)


def money(value: ColumnLike) -> Column:
    """Exact cents, so that sums do not depend on the order of the rows."""
    return _col(value).cast("decimal(18,2)")


def sum_money(value: ColumnLike) -> Column:
    return F.sum(money(value)).cast("double")
