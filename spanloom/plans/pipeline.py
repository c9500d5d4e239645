"""The chain from files to training samples, each stage a table named by its settings and made once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import detect, judge, records, sampling
from spanloom.sources.files import stage


@dataclass(frozen=True)
class Settings:
    subset: str = "java"
    enough: int = judge.ENOUGH
    n_train: int = sampling.N_TRAIN
    n_val: int = sampling.N_VAL
    seed: int = 42


def dataset(files: DataFrame, folder: str, settings: Settings = Settings(), backend: Callable[[DataFrame], DataFrame] = judge.rubric_judge) -> DataFrame:
    """Search, merge and clean, judge, split: (id, piiType, value, location_start, location_end, score, split)."""
    spark, config = files.sparkSession, asdict(settings)
    own = detect.only_language(files, settings.subset).dropDuplicates(["fileId"])
    texts = own.select("fileId", "content")

    def search() -> DataFrame:
        found = detect.search(own)
        stored = records.explode_records(own).drop("content", "isHumanReviewed")
        return found.select(*stored.columns).unionByName(stored.withColumn("piiId", F.col("piiId") + F.lit(1 << 20)))

    found = stage(spark, folder, "search", {"subset": settings.subset}, search)
    joined = found.join(texts, "fileId")
    clean = stage(spark, folder, "clean", {"subset": settings.subset}, lambda: records.clean(records.relocate(records.first_wins(records.strip_value(joined)))).drop("content"))
    asked = clean.join(texts, "fileId").withColumnRenamed("fileId", "id")
    judged = stage(spark, folder, "judged", {k: config[k] for k in ("subset", "enough")}, lambda: judge.fold(judge.prefiltered(asked), backend, settings.enough))
    return stage(spark, folder, "samples", config, lambda: sampling.stratified_split(judged, settings.n_train, settings.n_val, seed=settings.seed))
