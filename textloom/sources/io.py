"""Readers and writers: raw JSON, CSV and Parquet tables, stage checkpoints, pair caches, configurations, prompts."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .published import Published

TABLE = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])
PAIRS = T.StructType([T.StructField(n, T.StringType()) for n in ("label", "translated", "original")])
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"'}
STAGES = (0, 1, 2, 3)


def check_columns(df: DataFrame, path: str) -> DataFrame:
    missing = [c for c in ("text", "label") if c not in df.columns]
    if missing:
        raise KeyError(f"{path} lacks the columns {', '.join(missing)}; text and label are needed")
    return df


def read_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects; only text and label are read."""
    return spark.read.schema(TABLE).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TABLE) -> DataFrame:
    """Only a field without quotes and characters is null.

    Spark takes for null whatever equals ``nullValue``, so that is a name that no file has; NUL is its mark for no
    ``charToEscapeQuoteEscaping`` and would be left out of quoted fields, so the quote stands there.
    """
    header = spark.read.options(**_CSV, nullValue=uuid.uuid4().hex).csv(path)
    if schema is TABLE:
        check_columns(header, path)
    # By name: files may have their columns in another order, and more of them.
    return header.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def write_csv(df: DataFrame, path: str) -> None:
    """Blanks at a text's ends stay, an empty text is ``""`` and a null is nothing."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def with_row_id(df: DataFrame) -> DataFrame:
    """An identity for rows that come without one: increasing within the files, not consecutive."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _stage(root: str, stage: int) -> str:
    return f"{root.rstrip('/')}/stage{stage}.parquet"


def load_stage(spark: SparkSession, root: str, stage: int) -> tuple[DataFrame, int]:
    """The table of this stage or of the last one before it that is there, and which stage that is."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}; there are {STAGES}")
    published = Published(spark, f"{root.rstrip('/')}/stages")
    for s in range(stage, -1, -1):
        path = published.path(f"stage{s}") or (_stage(root, s) if exists(spark, _stage(root, s)) else None)
        if path:
            return check_columns(spark.read.parquet(path), path), s
    raise FileNotFoundError(f"no stage up to {stage} in {root}")


def save_stage(df: DataFrame, root: str, stage: int, *, initial: bool = False) -> str:
    """Stages 1 to 3; stage 0 is the split's own and needs ``initial``. The table's path.

    An older version stays readable until the new one is written and read back; a stage may be made from its own older version.
    """
    if stage not in STAGES or (stage == 0 and not initial):
        raise ValueError(f"stage {stage} can't be saved; stages 1 to 3 can")
    published = Published(df.sparkSession, f"{root.rstrip('/')}/stages")
    published.commit(f"stage{stage}", check_columns(df, f"stage {stage}"), replace=True)
    return published.path(f"stage{stage}")


def save_split(df: DataFrame, root: str) -> None:
    """Train as stage 0 and test, of a table with a column part."""
    save_stage(df.where("part = 'train'").drop("part"), root, 0, initial=True)
    df.where("part = 'test'").drop("part").write.mode("overwrite").parquet(f"{root.rstrip('/')}/test.parquet")


def load_test(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root.rstrip('/')}/test.parquet"
    if not exists(spark, path):
        raise FileNotFoundError(f"no test set at {path}; split the table first")
    return check_columns(spark.read.parquet(path), path)


class PairCache:
    """Accepted pairs (label, translated, original) of interrupted attempts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/pairs.parquet"

    def append(self, pairs: DataFrame) -> None:
        pairs.select(*[f.name for f in PAIRS]).write.mode("append").parquet(self.path)

    def read(self, pending: DataFrame) -> DataFrame:
        """Pairs whose label is still pending."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], PAIRS)
        return self.spark.read.schema(PAIRS).parquet(self.path).join(pending.select("label").distinct(), "label", "left_semi")

    def retire(self) -> str:
        """Renames the cache to a backup; the backup's path."""
        jvm = self.spark.sparkContext._jvm
        old, new = jvm.org.apache.hadoop.fs.Path(self.path), jvm.org.apache.hadoop.fs.Path(f"{self.path}.bak")
        fs = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(new, True)
        fs.rename(old, new)
        return new.toString()


MODEL_KEYS = ("model_name", "generation_params", "prompt_template")


def load_model_config(path: str | Path) -> dict[str, Any]:
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    missing = [k for k in MODEL_KEYS if k not in config]
    if missing:
        raise KeyError(f"{path} lacks {', '.join(missing)}")
    return config


def load_prompt(path: str | Path) -> str:
    if not Path(path).exists():
        raise FileNotFoundError(f"no prompt at {path}")
    return Path(path).read_text(encoding="utf-8").strip()


def load_prompt_template(name: str, root: str | Path) -> str:
    return load_prompt(Path(root) / (name if name.endswith(".txt") else f"{name}.txt"))


@dataclass
class PipelineConfig:
    gpu: dict[str, Any] = field(default_factory=dict)
    stages: dict[str, Any] = field(default_factory=dict)
    judge: dict[str, Any] = field(default_factory=dict)
    validation: dict[str, Any] = field(default_factory=dict)
    training: dict[str, Any] = field(default_factory=dict)


_configs: dict[tuple[str, str], PipelineConfig] = {}


def load_pipeline_config(path: str | Path, gpu: str = "L4") -> PipelineConfig:
    """The configuration with the profile of a GPU, whose name may be in lower case; read once for each."""
    gpu = gpu.upper()
    key = (str(path), gpu)
    if key not in _configs:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        if gpu not in raw["gpu_profiles"]:
            raise ValueError(f"unknown GPU {gpu}; there are {', '.join(raw['gpu_profiles'])}")
        _configs[key] = PipelineConfig(raw["gpu_profiles"][gpu], raw.get("pipeline", {}), raw.get("judge", {}), raw.get("validation", {}), raw.get("training", {}))
    return _configs[key]
