"""Writers of cached lines, vectors, feature tables, results and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, column: str, path: str) -> None:
    """A record per line."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def token_lists(df: DataFrame, key: str, tokens: str, path: str) -> None:
    """Cached reviews: a JSON object per line with the review's key and its sentences' words."""
    df.select(F.col(key).cast("string").alias("key"), F.col(tokens).alias("tokens")).write.mode("overwrite").json(path)


def vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def features(df: DataFrame, path: str, key: str = "file_name") -> None:
    """A feature table sorted by key, nulls first, in comma-separated files with header."""
    df.orderBy(F.asc_nulls_first(key)).write.mode("overwrite").csv(path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, header=True)


def results(df: DataFrame, path: str, first: dict[str, object] | None = None, sep: str = ",", null: str = "NaN", append: bool = False) -> None:
    """Result rows with constant columns put in front."""
    out = df.select(*(F.lit(v).alias(k) for k, v in (first or {}).items()), *df.columns)
    out.write.mode("append" if append else "overwrite").csv(path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, header=True, sep=sep, nullValue=null)


def predictions(df: DataFrame, path: str) -> None:
    """Predictions, a folder per fold."""
    df.write.mode("overwrite").partitionBy("fold").parquet(path)


def classes(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, header=True, sep=";")


def model(fitted, path: str) -> None:
    fitted.write().overwrite().save(path)


def latex(table: DataFrame, rows: str = "y_true", columns: str = "y_pred", value: str = "n") -> str:
    """A small table with margins as LaTeX; the table has a row per pair of classes, of which there are at most 1,000."""
    cells = {(r[rows], r[columns]): r[value] for r in table.collect()}
    heads = sorted({c for _, c in cells}, key=lambda c: (c == "All", c))
    sides = sorted({r for r, _ in cells}, key=lambda r: (r == "All", r))
    body = [" & ".join([str(r), *(str(cells.get((r, c), 0)) for c in heads)]) + r" \\" for r in sides]
    return "\n".join([r"\begin{tabular}{l" + "r" * len(heads) + "}", " & ".join(["", *map(str, heads)]) + r" \\", *body, r"\end{tabular}"])
