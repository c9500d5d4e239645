"""Helpers that the operators of this subpackage share: batch mapping, hashing and durable intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from spanloom.sources.durable import written

__all__ = ["Hashes", "grams", "map_rows", "mix", "table", "written"]

#: Rows of an Arrow batch are worked on in slices of about this many bytes, so that a worker's memory stays bounded.
SLICE_BYTES = 4_000_000


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[tuple]], schema: str) -> DataFrame:
    """Applies fn to column lists of a bounded number of bytes; fn yields output tuples in schema order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, int(batch.num_rows * min(1.0, SLICE_BYTES / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = list(fn({n: part.column(i).to_pylist() for i, n in enumerate(names)}))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return df.mapInArrow(run, schema)


class Hashes(dict):
    """word -> stable 64-bit hash, kept per worker process; cleared when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of unsigned integers."""
    x = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at these offsets from every place at which all of them exist, as signed 64-bit integers."""
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.int64)
    w = words.astype(np.uint64)
    acc = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, at in enumerate(offsets):
            acc = mix(acc * np.uint64(31) + w[at : at + n] + np.uint64(i + 1))
    return acc.view(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
