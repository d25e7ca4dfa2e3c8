"""One job from an increment of facts to merged facts, daily partials, profiles and profile documents.

Every step changes its table in one commit and can be repeated: a job that stops between two steps is run again with the same
increment and ends in the same state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize
from ..sources.sinks import write_documents
from ..sources.versioned import PART, Version, read_version, replace_parts, version
from .facts import KEYS, write_merged
from .profile import daily_partials, profile_90d_partials, span_name, write_profiles

SPAN = "event_span"


@dataclass(frozen=True)
class Store:
    """Where the tables of the job lie, all below one folder, and the unit of time that makes a part of them."""

    root: str
    unit: str = "day"

    @property
    def facts(self) -> str:
        return f"{self.root}/facts"

    @property
    def partials(self) -> str:
        return f"{self.root}/partials"

    @property
    def profiles(self) -> str:
        return f"{self.root}/profiles"

    @property
    def documents(self) -> str:
        return f"{self.root}/documents"


def _changed(before: Version, after: Version) -> list[str]:
    """Parts that are new, rewritten or gone."""
    names = before.parts.keys() | after.parts.keys()
    return sorted(n for n in names if before.parts.get(n) != after.parts.get(n))


def ingest(
    spark: SparkSession, store: Store, increment: DataFrame, labels: DataFrame, watermark: Column, as_of: Column, zone: str = "UTC"
) -> None:
    """Merge new, late and corrected facts, and bring the profiles of the customers they or new labels affect up to ``as_of``.

    Facts are stored by UTC day, or by month where days are small. Only parts whose facts changed are summed again: those of the increment, those
    that a corrected fact has left, and those whose partials an earlier, stopped run did not reach. An empty increment still updates
    the profiles that the clock affects.
    """
    span = F.date_trunc(store.unit, "event_time").cast("date")
    write_merged(spark, store.facts, increment.withColumn(SPAN, span), KEYS, SPAN)
    facts_now, partials_now = version(spark, store.facts), version(spark, store.partials)
    summed = partials_now.marks.get("facts")
    known = version(spark, store.facts, summed) if summed else Version()
    spans = _changed(known, facts_now)
    if spans:
        rows = daily_partials(read_version(spark, store.facts, facts_now, spans), zone).withColumn(PART, span_name(F.col("day"), store.unit))
        replace_parts(rows, store.partials, partials_now, spans, marks={"facts": facts_now.number})
    facts = read_version(spark, store.facts, facts_now)
    profiles = profile_90d_partials(spark, store.partials, facts, labels, watermark, as_of, zone, store.unit)
    profiles = materialize(profiles, "profiles")
    write_profiles(spark, store.profiles, profiles, profiles.select("customer_id"))
    write_documents(spark, store.documents, profiles, "customer_id", ["profile_as_of"])
    discard(profiles)
