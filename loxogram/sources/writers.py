"""Sinks for results and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str, separator: str = ",", decimal: str = ".") -> None:
    """CSV with a header; doubles take the locale's decimal symbol."""
    shown = results
    for name, kind in results.dtypes:
        if kind in ("double", "float") and decimal != ".":
            shown = shown.withColumn(name, F.regexp_replace(F.col(name).cast("string"), r"\.", decimal))
    shown.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def result_lines(results: DataFrame) -> DataFrame:
    """A line of text for each row, ``name=value`` by column, for plain text files."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in results.columns]
    return results.select(F.concat_ws(" ", *parts).alias("value"))


def write_text(results: DataFrame, path: str) -> None:
    result_lines(results).write.mode("overwrite").text(path)


def metrics_table(metrics: DataFrame, values: list | None = None) -> DataFrame:
    """(iteration, swept, seconds) to a row for each iteration and a column for each swept value."""
    return metrics.groupBy("iteration").pivot("swept", values).agg(F.first("seconds")).orderBy("iteration")


def plot_script(title: str, data_file: str, columns: list[str], separator: str = ",") -> str:
    """A gnuplot script that draws every column of a metrics file against the first."""
    lines = [f'set title "{title}"', f'set datafile separator "{separator}"', "set key autotitle columnheader", "set style data linespoints"]
    plots = ", ".join(f"'{data_file}' using 1:{i + 2}" for i in range(len(columns)))
    return "\n".join([*lines, f"plot {plots}"]) + "\n"
