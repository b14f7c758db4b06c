"""Any table with an id and a text column as a strings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens import fixed


def strings_from(df: DataFrame, prefix: str, id_col: str, text_col: str) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{prefix}/"), F.col(id_col).cast("string")).alias("artifact_id"),
        F.lit(0).cast("bigint").alias("str_idx"),
        F.lit(0).cast("bigint").alias("position"),
        F.col(text_col).alias("value"),
    )


def min_length(strings: DataFrame) -> DataFrame:
    """Strings longer than the noise limit."""
    return strings.filter(F.length("value") > fixed.MIN_STRING_LENGTH)
