"""Text and time forms used at file edges."""

from pyspark.sql import Column, functions as F

RUN_STAMP = "yyyyMMdd'T'HHmmss"  # fixed value: form of a run id


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, RUN_STAMP)


def clock_after(base: Column, seconds: Column) -> Column:
    """HHmmss of a base time plus seconds."""
    return F.date_format(base + F.make_dt_interval(secs=seconds), "HHmmss")


def short_number(x: Column, digits: int) -> Column:
    """Fixed digits, trailing zeros removed, at least one digit after the point kept away."""
    fixed = F.format_string(f"%.{digits}f", x)
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def plain_name(name: Column) -> Column:
    """Commas would split a CSV cell."""
    return F.regexp_replace(name, ",", "_")
