"""The two analytical views. Both are lazy: new rows in the source show at the next action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.operators import cleaning
from tilltrail.operators.imputation import impute_both


def purchases_view(
    clean: DataFrame,
    raw: DataFrame | None = None,
    strategy: str = "max",
    maps: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Clean rows with user type, calendar of the normalized clock, and no gaps.

    Stored ``maps`` are taken where given (by name of the dimension), else they are made from ``raw``
    or the clean rows. Columns the clean frame lacks, such as an id that was
    not asked for, are left out, with all that derives from them.
    """
    filled = impute_both(clean, raw, strategy, maps)
    typed = filled
    if "user_id" in typed.columns:
        typed = cleaning.add_user_type(typed)
    if "normalized_event_time" in typed.columns:
        typed = cleaning.add_calendar(typed, "normalized_event_time")
    return typed.select(*[c for c in S.VIEW_COLUMNS if c in typed.columns])


def baseline_view(raw: DataFrame, display_hours: int = S.CLOCK_OFFSET_HOURS) -> DataFrame:
    """Complete rows only, with the calendar of the recorded clock and blank-padded weekdays."""
    kept = cleaning.drop_incomplete(cleaning.drop_serial(raw))
    dated = kept
    if "event_time" in kept.columns:
        clocked = cleaning.normalize_event_time(kept, display_hours=display_hours)
        dated = cleaning.add_calendar(clocked, "event_time", padded=True)
    return dated.select(*[c for c in S.BASELINE_COLUMNS if c in dated.columns])


def baseline_of_year(view: DataFrame, year: int, **equal_to: str) -> DataFrame:
    """Baseline rows of one year, optionally of one category or brand."""
    kept = cleaning.in_year(view, year, "event_time")
    for name, value in equal_to.items():
        kept = kept.filter(F.col(name) == value)
    return kept
