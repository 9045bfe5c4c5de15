"""Log text as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = r"\[(\d\d:\d\d:\d\d)\] ([A-Z]+) "


def log_lines(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, clock, level, message) of each stamped line; other lines and null texts give none."""
    lines = df.select(ident, F.explode(F.split(text, "\n")).alias("line"))
    clock = F.regexp_extract("line", LINE, 1)
    return lines.select(ident, clock.alias("clock"), F.regexp_extract("line", LINE, 2).alias("level"), F.regexp_replace("line", "^.*?" + LINE, "").alias("message")).where("clock <> ''")
