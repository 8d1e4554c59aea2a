"""Scalar column functions (F1-F11, P2, P3, P10). All are built-in expressions:
they stay inside whole-stage codegen, no Python runs per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

CI = "UTF8_LCASE"  # case-insensitive collation, as MySQL's default one


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ci(c: str | Column) -> Column:
    """The column under case-insensitive collation (compare, group, join keys)."""
    return F.collate(_c(c), CI)


def ci_eq(c: str | Column, value: str | Column) -> Column:
    """Case-insensitive equality (P1 on text keys, MySQL's default collation)."""
    return ci(c) == (F.lit(value) if isinstance(value, str) else value)


def component_in(c: str | Column, ids: Iterable[str]) -> Column:
    """Case-insensitive IN list."""
    return ci(c).isin(list(ids))


def ci_prefix(c: str | Column, prefix: str) -> Column:
    """Case-insensitive prefix match, ``LIKE 'C%'``."""
    return ci(c).startswith(prefix)


def _without_keys(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith("_key") and c[:-4] in df.columns])


def key_in(df: DataFrame, column: str, ids: Iterable[str]) -> DataFrame:
    """Rows whose text key is one of ``ids``, case-insensitively (P1, P2). On a table stored with lower-case
    keys (``sources.keyed``) a plain filter that the scan takes; its key columns are dropped."""
    ids = list(ids)
    if f"{column}_key" in df.columns:
        return _without_keys(df.filter(F.col(f"{column}_key").isin([i.lower() for i in ids])))
    return df.filter(component_in(column, ids))


def key_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text key starts with ``prefix``, case-insensitively (P3); pushed like :func:`key_in`."""
    if f"{column}_key" in df.columns:
        return _without_keys(df.filter(F.col(f"{column}_key").startswith(prefix.lower())))
    return df.filter(ci_prefix(column, prefix))


def grade_score(c: str | Column, case_sensitive: bool = False) -> Column:
    """Recyclable grade to score: A 4, B 3, C 2, D 1, anything else 0 (F1).

    The stored function compares case-insensitively; the dashboard's Python
    lookup is case-sensitive (``case_sensitive=True``).
    """
    g = _c(c) if case_sensitive else F.upper(_c(c))
    expr = F.lit(0)
    for grade, score in reversed(list(schemas.GRADE_SCORES.items())):
        expr = F.when(g == grade, F.lit(score)).otherwise(expr)
    return expr


def hazard_flag(c: str | Column) -> Column:
    """Unknown or NULL hazard counts as not hazardous."""
    return F.coalesce(_c(c), F.lit(False))


def hazard_label(c: str | Column) -> Column:
    """'Yes' when hazardous, else 'No' (F7, the passport's projection)."""
    return F.when(_c(c), F.lit(schemas.HAZARD_YES)).otherwise(F.lit(schemas.HAZARD_NO))


def display_or_dash(c: str | Column) -> Column:
    """``value or '-'`` of the templates: NULL and empty text show '-' (F2)."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit("-"))


def event_time(c: str | Column) -> Column:
    """``DATE_FORMAT(d, '%Y-%m-%d %H:%i')``."""
    return F.date_format(_c(c), schemas.EVENT_TIME_FORMAT)


def option_label(id_col: str | Column, name_col: str | Column) -> Column:
    """Drop-down label ``id — name``."""
    return F.concat_ws(" — ", _c(id_col), _c(name_col))


def material_label(name_col: str | Column, hazardous_col: str | Column) -> Column:
    """``name (Hazard)`` for hazardous materials, else the name."""
    return F.when(hazard_flag(hazardous_col), F.concat(_c(name_col), F.lit(" (Hazard)"))) \
        .otherwise(_c(name_col))


def to_key(c: str | Column) -> Column:
    """Text key argument to an integer id; NULL when not a number."""
    return F.trim(_c(c).cast("string")).try_cast("bigint")


def to_weight(c: str | Column) -> Column:
    """Text or number to DECIMAL(10,2) as the procedure parameter does.

    Rounds half up to cents; NULL when not a number or out of range.
    """
    return _c(c).try_cast("decimal(10,2)")


def round_half_up(c: str | Column, digits: int) -> Column:
    """``round(x, n)`` (F8): Spark rounds half up on the decimal value."""
    return F.round(_c(c), digits)


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den in double, NULL when den is 0 or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
