"""Cutoff windows and date parsing."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Windows:
    """Two 365-day windows that end at the cutoff: [previous, recent) and [recent, cutoff]."""

    previous: dt.date
    recent: dt.date
    cutoff: dt.date

    @classmethod
    def ending(cls, cutoff: dt.date, days: int = 365) -> Windows:
        return cls(cutoff - dt.timedelta(2 * days), cutoff - dt.timedelta(days), cutoff)

    def of(self, published: Column) -> Column:
        return (
            F.when((published >= F.lit(self.previous)) & (published < F.lit(self.recent)), "previous")
            .when((published >= F.lit(self.recent)) & (published <= F.lit(self.cutoff)), "recent")
            .otherwise("unknown_date")
        )


def news_timestamp(value: Column) -> Column:
    """Compact, basic-UTC and ISO forms used by article feeds."""
    text = F.trim(value)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")),
        F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
    )


def iso_date(value: Column) -> Column:
    """Strict yyyy-MM-dd; anything else is null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def whole_count(value: Column) -> Column:
    """Non-negative whole number given as text, integer or integral float; else null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[0-9]+(\.0+)?$"), F.regexp_replace(text, r"\..*$", "").try_cast("bigint"))
