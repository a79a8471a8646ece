"""Row filters shared by operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in all the columns, as plain filters that reach the files."""
    for column in columns:
        df = df.where(F.col(column).isNotNull())
    return df


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores added until no column of `df` has this name in any spelling."""
    taken = {column.lower() for column in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without_nan(df: DataFrame, column: str) -> DataFrame:
    """NaN in a column of floating numbers becomes missing; other columns stay as they are."""
    if df.schema[column].dataType.typeName() not in ("double", "float"):
        return df
    return df.withColumn(column, F.when(~F.isnan(column), F.col(column)))
