"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone: the same on every run and machine.

    For reproducible experiments. It is not a source of cryptographic noise: for
    real reports put a secure one in its place.
    """
    key = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(2**52)


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def keep_chance(eps: Column, d: Column) -> Column:
    """Chance that randomised response over d values keeps the value."""
    return F.when(d == 1, 1.0).otherwise(F.exp(eps) / (F.exp(eps) + d - 1))


def other_chance(eps: Column, d: Column) -> Column:
    return F.when(d == 1, 0.0).otherwise(1 / (F.exp(eps) + d - 1))


def respond(position: Column, d: Column, eps: Column, keep: Column, pick: Column) -> Column:
    """The 0-based position that generalised randomised response reports.

    keep and pick are uniform; pick chooses evenly among the d-1 other positions.
    """
    other = F.pmod(position + 1 + F.floor(pick * (d - 1)), F.greatest(d, F.lit(1)))
    return F.when((d == 1) | (keep < keep_chance(eps, d)), position).otherwise(other).cast("int")


def threshold_bucket(score: Column, thresholds) -> Column:
    """1 from the first threshold on, 2 from the second, and so on."""
    out = F.lit(len(thresholds) + 1)
    for k in range(len(thresholds), 0, -1):
        out = F.when(score >= thresholds[k - 1], k).otherwise(out)
    return out


def first_present(df, names: list[str]) -> Column:
    """The first of the columns that df has and that is not null or empty; null if it has none."""
    have = [F.when(F.col(f"`{n}`").cast("string") != "", F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


# Names under which tables hold a piece's first segment, its length, and a sequence (fixed values).
START_NAMES = ["start", "start_segment", "x_start"]
COUNT_NAMES = ["cnt", "count", "num_segments"]
LENGTH_NAMES = ["num_segments", "parent_num_segments", "length"]


def event_start(df) -> Column:
    """A piece's first segment, by the first name that df has for it, else of its segments."""
    return F.coalesce(first_present(df, START_NAMES), F.get("segments", F.lit(0)) if "segments" in df.columns else F.lit(None))


def event_count(df) -> Column:
    """A piece's number of segments, by the first name that df has for it, else of its segments."""
    return F.coalesce(first_present(df, COUNT_NAMES).cast("int"), segment_length(df))


def segment_length(df) -> Column:
    """The number of segments of a row: of the list if df has it, else the first stored length."""
    if "segments" in df.columns:
        return F.when(F.col("segments").isNotNull(), F.size("segments"))
    return first_present(df, LENGTH_NAMES).cast("int")


def nested(json: Column, path: str, default: str | None = None) -> Column:
    """The value at a dotted path of a JSON document, else the default."""
    value = F.get_json_object(json, "$." + path)
    return value if default is None else F.coalesce(value, F.lit(default))


def safe_number(x: Column, default: float | None = None) -> Column:
    """x as a finite double, else the default."""
    value = x.try_cast("double")
    value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return value if default is None else F.coalesce(value, F.lit(default))
