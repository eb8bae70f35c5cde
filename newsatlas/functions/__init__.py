"""Column expressions; everything here stays in the JVM."""

from pyspark.sql import Column, functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
