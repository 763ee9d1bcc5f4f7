"""Number coercion and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half(c: Column, digits: int) -> Column:
    """Half-away-from-zero rounding of a double, decided on its value at 9
    decimals (DECIMAL(38, 9)), so summation noise in the 16th digit of an
    average cannot flip an exact tie such as 0.00725."""
    return F.round(c.cast("decimal(38,9)"), digits).cast("double")


# text that the engine reads as a number and the callers' rule does not: a type
# suffix or a hexadecimal float
_NOT_DECIMAL = r"(?i)(0x|[0-9.][df]\s*$)"


def text_number(text: Column) -> Column:
    """DOUBLE of decimal text; NULL for other text."""
    return F.when(~text.rlike(_NOT_DECIMAL), text.try_cast("double"))


def to_number(c: Column | str) -> Column:
    """Coerce anything to DOUBLE; invalid text -> NULL, and 'NaN' -> NULL."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nanvl(text_number(col.cast("string")), F.lit(None).cast("double"))


def number_of(df, name: str) -> Column:
    """N7 for a column of ``df``: numeric columns are cast as they are, only the
    others go through text."""
    from pyspark.sql.types import NumericType
    if isinstance(df.schema[name].dataType, NumericType):
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return to_number(name)


def nan_to_null(df):
    """Source boundary rule: NaN in floating columns becomes NULL (Spark
    orders NaN above every number, pandas treats it as missing)."""
    from pyspark.sql.types import DoubleType, FloatType
    cols = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
            for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(cols) if cols else df
