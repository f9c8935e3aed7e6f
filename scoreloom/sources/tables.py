"""Sources and sinks: CSV files, Parquet tables, prediction and parameter tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.nulls import finite_frame

DEBUG_ROWS = 200  # fixed value: rows read in debug mode


def read_csv_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    debug: bool = False,
    num_rows: int = DEBUG_ROWS,
) -> DataFrame:
    """CSV with a header row. Give a schema: inferring one reads the files twice."""
    reader = spark.read.option("header", True).option("nanValue", "nan")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = finite_frame(reader.csv(path))
    return df.limit(num_rows) if debug else df


def read_table(
    spark: SparkSession, name: str, folders: Sequence[str] | str, debug: bool = False, num_rows: int = DEBUG_ROWS
) -> DataFrame:
    """``{folder}/{name}.parquet`` from the first folder that has it."""
    folders = [folders] if isinstance(folders, str) else list(folders)
    for folder in folders:
        try:
            df = finite_frame(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return df.limit(num_rows) if debug else df
    raise FileNotFoundError(f"{name}.parquet in none of {folders}")


def categories_as_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns as plain strings (coded categories become their text)."""
    return df.withColumns({c: F.col(c).cast(StringType()) for c in columns})


def write_csv_table(df: DataFrame, path: str) -> None:
    """Prediction, submission or importance table as CSV with a header row."""
    df.write.mode("overwrite").option("header", True).csv(path)


def parameter_table(spark: SparkSession, params: Mapping, auc: float = 999) -> DataFrame:
    """Run parameters as (auc, key, value) rows, AUC rounded to five places."""
    rows = [(round(float(auc), 5), str(k), str(v)) for k, v in params.items()]
    return spark.createDataFrame(rows, "auc double, key string, value string")


def write_parameters(spark: SparkSession, params: Mapping, path: str, auc: float = 999) -> None:
    """One ``key:value,`` line per parameter in a folder named after the AUC."""
    table = parameter_table(spark, params, auc)
    lines = table.select(F.concat_ws("", F.concat_ws(":", "key", "value"), F.lit(",")).alias("value"), "auc")
    lines.coalesce(1).write.mode("append").partitionBy("auc").text(path)
