"""Readers that keep where each row came from."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unique_headers(values: Sequence[str]) -> list[str]:
    """White space collapsed; a repeated header gets ``__2``, ``__3`` ..."""
    seen: Counter = Counter()
    out = []
    for value in values:
        name = " ".join(value.split())
        seen[name] += 1
        out.append(name if seen[name] == 1 else f"{name}__{seen[name]}")
    return out


def read_export(spark: SparkSession, path: str, *, metadata_rows: int = 0) -> DataFrame:
    """A CSV export: metadata rows skipped, blank rows dropped, ragged rows an error; adds source_row (1-based) and raw_row (sorted JSON).

    Records may span lines, so a file is read in one task: row numbers need its order.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))

    def rows(batches):
        import csv
        import io

        import pandas as pd

        for batch in batches:
            for text in batch["value"]:
                found = [(k, r) for k, r in enumerate(csv.reader(io.StringIO(text)), 1) if k > metadata_rows and any(c.strip() for c in r)]
                width = len(found[0][1]) if found else 0
                for k, r in found:
                    if len(r) != width:
                        raise ValueError(f"row {k} has {len(r)} fields instead of {width}")
                yield pd.DataFrame({"n": [k for k, _ in found], "cells": [r for _, r in found]})

    cells = raw.mapInPandas(rows, "n long, cells array<string>")
    header = cells.orderBy("n").first()
    if header is None:
        raise ValueError("the export has no header")
    names = unique_headers(header.cells)
    data = cells.where(F.col("n") > header.n).select(F.col("n").alias("source_row"), *(F.trim(F.col("cells")[i]).alias(n) for i, n in enumerate(names)))
    return data.withColumn("raw_row", F.to_json(F.struct(*(F.col(f"`{n}`") for n in sorted(names)))))


def map_columns(df: DataFrame, names: dict[str, str], *, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Canonical name -> source column; required names must be mapped and present, unknown ones are an error."""
    unknown = set(names) - set(required) - set(optional)
    absent = [n for n in required if n not in names or names[n] not in df.columns]
    if unknown or absent:
        raise ValueError(f"unknown: {sorted(unknown)}; absent: {absent}")
    keep = [c for c in ("source_row", "raw_row") if c in df.columns]
    return df.select(*keep, *(F.col(f"`{c}`").alias(n) for n, c in names.items() if c in df.columns))


def require(df: DataFrame, columns: Sequence[str], *, unique: Sequence[str] = ()) -> DataFrame:
    """Strings trimmed, nulls as empty; raises for absent columns and repeated keys."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns are absent: {absent}")
    if unique and df.groupBy(*unique).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated: {list(unique)}")
    strings = {n for n, t in df.dtypes if t == "string"}
    return df.select(*(F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) if c in strings else F.col(c) for c in df.columns))


def registry_rows(df: DataFrame, column: str) -> DataFrame:
    """``{"fields": [...], "data": [[...], ...]}`` as maps of field to value; rows of another length are dropped."""
    doc = F.from_json(column, "fields array<string>, data array<array<string>>")
    rows = df.select(doc.alias("d")).select("d.fields", F.explode("d.data").alias("row"))
    return rows.where(F.size("row") == F.size("fields")).select(F.map_from_arrays("fields", "row").alias("record"))


def columnar_rows(df: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """Parallel JSON arrays as rows; shorter arrays give nulls."""
    doc = F.from_json(column, ", ".join(f"`{f}` array<string>" for f in fields))
    return df.select(doc.alias("d")).select(F.inline(F.arrays_zip(*(F.col(f"d.`{f}`").alias(f) for f in fields))))


def read_cached_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Cached bodies by the SHA-256 of their URL (the file's name), decoded as UTF-8 or else Windows-1252."""
    files = spark.read.format("binaryFile").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.regexp_extract("path", r"([0-9a-f]{64})", 1).alias("url_sha256"), F.coalesce(utf8, F.decode("content", "windows-1252")).alias("body"), F.sha2("content", 256).alias("content_sha256"))
