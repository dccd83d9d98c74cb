"""Integer readings of zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def ntz_micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp since 1970-01-01, whatever the session's zone."""
    return (
        F.unix_date(ts.cast("date")).cast("long") * DAY_US
        + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000
        + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    )
