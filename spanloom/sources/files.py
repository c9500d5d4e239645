"""Files in and out.

Formats: JSON arrays, JSON lines, text by lines, CSV without a header, parquet. Pickles are refused, since reading one runs
code. Writing goes through the writer's commit protocol, so that a failed job leaves no half file behind.
"""

from __future__ import annotations

import json
import os
import re
from hashlib import md5
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def credentials(*names: str) -> dict[str, str]:
    """From the environment only; a missing one is an error."""
    missing = [n for n in names if not os.environ.get(n)]
    if missing:
        raise ValueError(f"set {', '.join(missing)} in the environment")
    return {n: os.environ[n] for n in names}


def read_blobs(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Stored contents (gzip or not) by name: blobId, content, lengthBytes. Undecodable ones give a null content and are
    for the caller to drop; the first n by name, if n is given."""
    import gzip

    import pyarrow as pa

    def text(data: bytes) -> str | None:
        try:
            return (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8")
        except (OSError, EOFError, UnicodeDecodeError):
            return None

    def run(batches):
        for batch in batches:
            contents = pa.array(map(text, batch.column(1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), contents, batch.column(2)], names=["blobId", "content", "lengthBytes"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = found.select(F.regexp_extract("path", r"([^/]+?)(?:\.gz)?$", 1).alias("blobId"), F.col("content"), F.col("length").alias("lengthBytes"))
    rows = named.mapInArrow(run, "blobId string, content string, lengthBytes long")
    return rows if n is None else rows.orderBy("blobId").limit(n)


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """S3: by suffix. Text gives `value` per line, CSV strings by position."""
    suffix = os.path.splitext(path)[1]
    if suffix not in (".json", ".jsonl", ".txt", ".csv", ".parquet"):
        raise ValueError(f"can't read {suffix or 'a file without a suffix'}: json, jsonl, txt, csv or parquet")
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    readers = {".json": lambda: spark.read.json(path, multiLine=True), ".jsonl": lambda: spark.read.json(path), ".txt": lambda: spark.read.text(path), ".csv": lambda: spark.read.csv(path, header=False), ".parquet": lambda: spark.read.parquet(path)}
    return readers[suffix]()


def last_number(path):
    """The last whole number of a path, 0 without one: the order of numbered files."""
    numbers = F.regexp_extract_all(path, F.lit(r"(\d+)"), F.lit(1))
    return F.coalesce(F.try_element_at(numbers, F.lit(-1)).try_cast("bigint"), F.lit(0).cast("bigint"))


def find_files(folder: str, suffix: str = ".jsonl", natural: bool = True) -> list[str]:
    """The files below a folder, by the last number in their path."""
    found = sorted(str(p) for p in Path(folder).rglob(f"*{suffix}"))
    return sorted(found, key=lambda p: int(n[-1]) if (n := re.findall(r"\d+", p)) else 0) if natural else found


def save_json(value, path: str) -> str:
    """A small value as one JSON file, put in place at once; the suffix is added if it lacks."""
    path = path if path.endswith(".json") else path + ".json"
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    return path


def save_jsonl(df: DataFrame, path: str) -> str:
    """One object per line, in a folder."""
    path = path if path.endswith(".jsonl") else path + ".jsonl"
    df.write.mode("overwrite").json(path)
    return path


def load_json_safe(path: str, default=None):
    """A JSON file; if it broke off, what ends with its last brace, which is then kept; else the default."""
    default = {} if default is None else default
    try:
        text = Path(path).read_text(encoding="utf-8")
    except FileNotFoundError:
        return default
    for cut in (text, text[: text.rfind("}") + 1], text[: text.rfind("}") + 1] + "]", text[: text.rfind("}") + 1] + "}"):
        try:
            value = json.loads(cut)
        except ValueError:
            continue
        if cut is not text:
            save_json(value, path)
        return value
    return default


def stage(spark: SparkSession, folder: str, name: str, config: dict, make) -> DataFrame:
    """The output of a stage, made once for each configuration: a table named by the hash of its sorted settings."""
    tag = md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]
    path = f"{folder.rstrip('/')}/{name}_{tag}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fuller_cache(one: DataFrame | None, two: DataFrame | None) -> DataFrame | None:
    """Of a cache and its backup the one with more entries, the cache among equals."""
    if one is None or two is None:
        return one if two is None else two
    return two if two.count() > one.count() else one


def text_source(df: DataFrame, validation_percent: int = 5) -> tuple[DataFrame, DataFrame]:
    """The column `text`, or the first one, as (train, validation): a share by hash of the text."""
    own = df.select(F.col("text" if "text" in df.columns else df.columns[0]).cast("string").alias("text"))
    held = F.pmod(F.xxhash64("text"), F.lit(100)) < validation_percent
    return own.filter(~held), own.filter(held)


def read_folder(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON files (arrays, objects or lines) of many folders, with the path they came from and its stem."""
    rows = spark.read.json(pattern, multiLine=True)
    return rows.withColumn("source_path", F.input_file_name()).withColumn("stem", F.regexp_extract("source_path", r"([^/]+?)\.[^./]+$", 1))


def save_pages(df: DataFrame, body: str, path: str) -> None:
    """A text column as files of lines."""
    df.select(F.col(body).alias("value")).write.mode("overwrite").text(path, lineSep="\n")
