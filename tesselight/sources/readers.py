"""Files: CSV in both readings, path resolution, manifests."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null marker that no file holds: an all-text read has no missing values.
NO_NULL = "\x00no-null\x00"


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and inferred types; empty fields are missing."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every field as text, nothing missing."""
    df = spark.read.option("nullValue", NO_NULL).option("emptyValue", "").csv(path, header=True, inferSchema=False)
    return df.na.fill("")


def datasets(folder: str) -> list[str]:
    return sorted(str(p) for p in Path(folder).glob("*.csv"))


def size_text(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError


def resolve(arg: str, found: list[str]) -> str:
    """A path, a number from 1, a file's stem, or a part of exactly one name."""
    if Path(arg).is_file():
        return arg
    if arg.isdigit() and 1 <= int(arg) <= len(found):
        return found[int(arg) - 1]
    if same := [p for p in found if Path(p).stem == arg]:
        return same[0]
    near = [p for p in found if arg.lower() in Path(p).name.lower()]
    if len(near) != 1:
        raise ValueError(f"{arg!r} names {len(near)} data sets")
    return near[0]


@dataclass(frozen=True)
class Entry:
    file: str
    rows: int
    columns: int
    target: str
    sha256: str


def manifest(path: str) -> list[Entry]:
    with open(path, newline="") as f:
        return [Entry(r["file"], int(r["rows"]), int(r["columns"]), r["target"], r["sha256"]) for r in csv.DictReader(f)]


def verify(spark: SparkSession, folder: str, entry: Entry) -> list[str]:
    """What differs between a file and its manifest entry."""
    path = f"{folder}/{entry.file}"
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    df = read_text(spark, path)
    wrong = []
    if digest != entry.sha256:
        wrong.append("sha256")
    if (df.count(), len(df.columns)) != (entry.rows, entry.columns):
        wrong.append("shape")
    if entry.target not in df.columns:
        wrong.append("target")
    return wrong


def load_verified(spark: SparkSession, folder: str, entry: Entry) -> DataFrame:
    if wrong := verify(spark, folder, entry):
        raise ValueError(f"{entry.file} differs from its manifest: {', '.join(wrong)}")
    return read_text(spark, f"{folder}/{entry.file}")


def unlisted(folder: str, entries: list[Entry]) -> list[str]:
    return sorted({Path(p).name for p in datasets(folder)} - {e.file for e in entries})
