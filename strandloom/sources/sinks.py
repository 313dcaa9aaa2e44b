"""Sinks: Parquet and CSV with a stable column order, reports, charts and publishing."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.text import checksums


def ordered_columns(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Columns in name order, or ``fields`` only, those that are missing as null."""
    if fields is None:
        return df.select(*sorted(df.columns))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """With header; arrays are joined by ``;`` and nulls are empty."""
    out = ordered_columns(df, fields)
    flat = [F.array_join(F.col(c), ";").alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in out.dtypes]
    out.select(*flat).write.mode(mode).option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, fields: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    ordered_columns(df, fields).write.mode(mode).option("compression", "zstd").parquet(path)


def publish(spark: SparkSession, staged: str, final: str) -> None:
    """Move a finished folder to its place in one rename; what is there already is never replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(final)
    fs = a.getFileSystem(conf)
    if fs.exists(b):
        raise FileExistsError(final)
    if not fs.rename(a, b):
        raise OSError(f"{staged} could not be moved to {final}")


def write_checksums(spark: SparkSession, folder: str, out: str) -> None:
    """A ``sha256  path`` line for every file of a folder, sorted by path."""
    checksums(spark, folder).select(F.concat_ws("  ", "sha256", "path").alias("value")).coalesce(1).write.text(out)


def source_manifest(files: DataFrame, catalog: DataFrame, folder: str = "folder") -> DataFrame:
    """Files with bytes and digest beside what a small catalog says of their folder."""
    named = files.withColumn(folder, F.element_at(F.split("path", "/"), -2))
    return named.join(catalog, folder, "left")


def bar_chart(title: str, items: Sequence[tuple[str, float]], width: int = 640, height: int = 22) -> str:
    """An SVG of labelled bars for a small aggregate."""
    top = max([v for _, v in items], default=0) or 1
    escape = lambda x: str(x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    rows = [f'<text x="4" y="{(i + 2) * height - 6}">{escape(k)}</text><rect x="180" y="{(i + 1) * height + 3}" width="{(width - 260) * v / top:.1f}" height="{height - 6}"/><text x="{188 + (width - 260) * v / top:.1f}" y="{(i + 2) * height - 6}">{escape(v)}</text>' for i, (k, v) in enumerate(items)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{(len(items) + 2) * height}"><text x="4" y="16">{escape(title)}</text>{"".join(rows)}</svg>'


def report(title: str, values: dict) -> tuple[str, str]:
    """Markdown and JSON of a small set of named values."""
    lines = [f"# {title}", "", "| item | value |", "|-|-|", *[f"| {k} | {v} |" for k, v in values.items()]]
    return "\n".join(lines) + "\n", json.dumps(values, indent=2, sort_keys=True, default=str)


def measured(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, object]:
    """``df`` with an observation of aggregate ``metrics`` that fills as it is written, at no extra pass."""
    seen = Observation(name)
    return df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), seen
