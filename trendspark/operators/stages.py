"""Jobs of several stages that go on from the last stage written: tables under a directory and a manifest of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.session import materialize

MANIFEST = "stage string, input string, path string"


def fingerprint(*frames: DataFrame) -> str:
    """The same for the same columns and rows, in any order."""
    out = []
    for df in frames:
        row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
        n, total, mixed = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(row))).first()
        out.append(f"{','.join(sorted(df.columns))}:{n}:{total}:{mixed}")
    return "|".join(out)


class Stages:
    """Tables of a job by stage. A stage whose table the manifest names for the same input is read, not made again.

    The manifest, (stage, input, path), gets its row after the table is written whole, so a job that was stopped at any
    point makes only what is missing. Other inputs may share the directory. Without a path tables are made anew.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *inputs: DataFrame) -> None:
        self.spark, self.path, self.made = spark, path, []
        self.input = fingerprint(*inputs) if path else ""
        self.known: dict[str, str] = {}
        if path:
            try:
                rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where(F.col("input") == self.input).collect()  # a row for each stage
                self.known = {r["stage"]: r["path"] for r in rows}
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                    raise

    def __call__(self, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        if self.path is None:
            return materialize(make(), stage)
        if stage not in self.known:
            df, path = make(), f"{self.path}/{stage}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            self.spark.createDataFrame([(stage, self.input, path)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
            self.known[stage] = path
            self.made.append(stage)
        return self.spark.read.parquet(self.known[stage])
