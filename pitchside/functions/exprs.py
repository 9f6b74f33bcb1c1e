"""Column-expression helpers that keep R's NULL/NaN/rounding rules on Spark.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` or a
Spark SQL expression, so it stays inside whole-stage codegen; no Python runs per
row. When the input is a column name, the helpers build one SQL expression
(one call to the JVM instead of one per Column operation).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Numbers R's as.numeric accepts and Spark's cast agrees on. Spark's cast also
# accepts forms like "1.5d" or "1f" that R rejects, so text must match this first.
NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ref(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def null_double() -> Column:
    return F.lit(None).cast("double")


def nan_to_null(c: ColumnLike) -> Column:
    """NaN becomes NULL (R's is.na is TRUE for NaN; SQL's IS NULL is not)."""
    c = col(c)
    return F.nanvl(c, null_double())


def parse_number(c: ColumnLike) -> Column:
    """R ``as.numeric(as.character(x))``: numeric text to double, anything else NULL.

    NaN text parses to NaN in R; it is mapped to NULL right away because every
    consumer treats it as missing.
    """
    if isinstance(c, str):
        t = f"trim(CAST({_ref(c)} AS STRING))"
        return F.expr(f"nanvl(CASE WHEN {t} RLIKE r'{NUMERIC_TEXT}' THEN try_cast({t} AS DOUBLE) END, "
                      f"CAST(NULL AS DOUBLE))")
    text = F.trim(col(c).cast("string"))
    parsed = F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))
    return nan_to_null(parsed)


def r_ifelse(cond: Column, yes: ColumnLike, no: ColumnLike) -> Column:
    """R ``ifelse``: a NULL condition gives NULL (SQL CASE would take ELSE)."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, col(yes)).otherwise(col(no))


def r_pmin(c: ColumnLike, bound: float) -> Column:
    """R ``pmin(x, b)``: NULL stays NULL (``least`` would return the bound)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(float(bound))))


def r_pmax(c: ColumnLike, bound: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(bound))))


def clip(c: ColumnLike, lo: float, hi: float) -> Column:
    """``pmax(lo, pmin(hi, x))`` with NULL propagation."""
    return r_pmax(r_pmin(c, hi), lo)


def safe_div(num: ColumnLike, den: ColumnLike) -> Column:
    """Division that yields NULL on a zero divisor instead of raising (ANSI mode)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def lookup(c: ColumnLike, mapping: Mapping, default) -> Column:
    """A CASE over a fixed mapping, ``default`` for anything else (incl. NULL)."""
    if isinstance(c, str):
        whens = " ".join(f"WHEN {_sql_literal(k)} THEN {_sql_literal(v)}" for k, v in mapping.items())
        return F.expr(f"CASE {_ref(c)} {whens} ELSE {_sql_literal(default)} END")
    c = col(c)
    expr = None
    for key, value in mapping.items():
        expr = F.when(c == F.lit(key), F.lit(value)) if expr is None else expr.when(c == F.lit(key), F.lit(value))
    return expr.otherwise(F.lit(default))


def ordinal(c: ColumnLike, levels: Iterable[str]) -> Column:
    """Position of ``c`` in ``levels`` (0-based); values outside sort last."""
    levels = list(levels)
    return lookup(c, {name: i for i, name in enumerate(levels)}, len(levels))


def num_text(c: ColumnLike, digits: int) -> Column:
    """R's printing of a number rounded to ``digits``: ``4.3``, ``12.5``, ``45``.

    The value is rounded half-to-even (R ``round``), printed with ``digits``
    decimals, then trailing zeros and a bare point are dropped. NULL stays NULL.
    """
    if isinstance(c, str):
        r = f"(bround(CAST({_ref(c)} AS DOUBLE), {digits}) + 0.0D)"  # + 0.0 turns -0.0 into 0.0
        if digits <= 0:
            return F.expr(f"CASE WHEN {_ref(c)} IS NOT NULL THEN format_string('%.0f', {r}) END")
        return F.expr(f"CASE WHEN {_ref(c)} IS NOT NULL THEN "
                      f"regexp_replace(format_string('%.{digits}f', {r}), r'\\.?0+$', '') END")
    c = col(c)
    rounded = F.bround(c.cast("double"), digits) + F.lit(0.0)  # + 0.0 turns -0.0 into 0.0
    if digits <= 0:
        return F.when(c.isNotNull(), F.format_string("%.0f", rounded))
    text = F.format_string(f"%.{digits}f", rounded)
    return F.when(c.isNotNull(), F.regexp_replace(text, r"\.?0+$", ""))


def r_paste(*parts: ColumnLike, sep: str = " ") -> Column:
    """R ``paste``: NULL pieces print as the text ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(col(p).cast("string"), F.lit("NA")) for p in parts])


def round_all_numeric(df, digits: int = 2):
    """``mutate(across(where(is.numeric), ~round(., digits)))``: a plan-time loop over the schema."""
    numeric = {"double", "float"}
    cols = []
    for field in df.schema.fields:
        if field.dataType.typeName() in numeric or field.dataType.typeName().startswith("decimal"):
            cols.append(F.bround(F.col(field.name), digits).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)
