"""The cleaning pipeline as one lazy plan, in the original stage order.

raw -> dedup (raw columns) -> header names -> dates -> drop missing date
-> numbers -> drop missing target -> schema check -> 1.5*IQR fence on
units_sold over the whole cleaned table -> calendar features + promotion
flag -> discount NULL -> 0.

The fence is computed before any user filter: its bounds come from a
separate aggregate branch, so a later filter cannot be pushed into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import clean, quality
from ..session import freed_shuffles


@dataclass
class Stages:
    """Intermediate frames of the pipeline (all lazy)."""

    raw: DataFrame
    deduped: DataFrame
    cleaned: DataFrame
    kept: DataFrame
    processed: DataFrame


def stages(raw: DataFrame, date_formats: list[str] | None = None, approx_fence: bool = False,
           cleaned_path: str | None = None, distinct: bool = False) -> Stages:
    """Build every stage lazily. ``distinct`` says that ``raw`` holds no repeated rows any more.

    The fence reads the cleaned table twice (once for the quartiles, once to
    filter). With ``cleaned_path`` the cleaned table is written there as
    Parquet first, so the joins and the de-duplication run once and the
    quartile pass scans a single column; without it the plan stays lazy.
    """
    deduped = clean.normalise_headers(raw if distinct else clean.dedup_rows(raw))
    deduped = clean.parse_dates(deduped, "date", date_formats)
    cleaned = clean.drop_missing(deduped, ["date"])
    cleaned = clean.coerce_numeric(cleaned)
    cleaned = clean.drop_missing(cleaned, ["units_sold"])
    quality.check_schema(cleaned)
    if cleaned_path is not None:
        with freed_shuffles(cleaned.sparkSession):
            cleaned.write.mode("overwrite").option("compression", "zstd").parquet(cleaned_path)
        cleaned = cleaned.sparkSession.read.parquet(cleaned_path)
    kept = clean.outlier_fence(cleaned, "units_sold", approx=approx_fence)
    processed = clean.fill_discount(clean.add_features(kept))
    return Stages(raw, deduped, cleaned, kept, processed)


def observed_stages(raw: DataFrame, cleaned_path: str, date_formats: list[str] | None = None) -> tuple[Stages, dict[str, int]]:
    """The pipeline with its stages' row counts, observed while the cleaned table is written.

    The joins and the de-duplication run once; the fence's count is one more
    pass over the written table.
    """
    seen = {name: Observation() for name in ("raw", "deduplicated", "valid_target")}
    n = F.count(F.lit(1)).alias("n")
    deduped = clean.normalise_headers(clean.dedup_rows(raw.observe(seen["raw"], n)))
    deduped = clean.parse_dates(deduped, "date", date_formats)
    deduped = deduped.observe(seen["deduplicated"], n, F.count("date").alias("dated"))
    cleaned = clean.drop_missing(clean.coerce_numeric(clean.drop_missing(deduped, ["date"])), ["units_sold"])
    quality.check_schema(cleaned)
    cleaned.observe(seen["valid_target"], n).write.mode("overwrite").parquet(cleaned_path)
    cleaned = raw.sparkSession.read.parquet(cleaned_path)
    kept = clean.outlier_fence(cleaned, "units_sold")
    counts = {name: o.get["n"] for name, o in seen.items()} | {"valid_date": seen["deduplicated"].get["dated"], "within_fence": kept.count()}
    return Stages(raw, deduped, cleaned, kept, clean.fill_discount(clean.add_features(kept))), counts


def prepare(raw: DataFrame, date_formats: list[str] | None = None, approx_fence: bool = False,
            cleaned_path: str | None = None, distinct: bool = False) -> DataFrame:
    """The processed sales table (lazy unless ``cleaned_path`` is given)."""
    return stages(raw, date_formats, approx_fence, cleaned_path, distinct).processed
