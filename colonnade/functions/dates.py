"""Reading dates out of text, and the calendar parts used as features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text layouts accepted as a date or a time, tried in this order.
DATE_LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "MM-dd-yyyy",
    "dd.MM.yyyy",
    "dd MMM yyyy",
    "MMM dd, yyyy",
    "yyyyMMdd",
)

DATE_PARTS = ("year", "month", "day", "dayofweek")


def read_datetime(text: Column) -> Column:
    """The first layout that fits; NULL where none does."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(layout)) for layout in DATE_LAYOUTS])


def date_parts(stamp: Column) -> dict[str, Column]:
    """Year, month, day and weekday, with Monday as 0."""
    return {
        "year": F.year(stamp),
        "month": F.month(stamp),
        "day": F.dayofmonth(stamp),
        "dayofweek": F.weekday(stamp),
    }
