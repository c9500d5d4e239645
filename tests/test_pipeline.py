"""The chain from files to samples, and that a second run makes nothing anew."""

from spanloom.operators import judge
from spanloom.plans.pipeline import Settings, dataset


def test_files_to_samples(spark, tmp_path):
    files = spark.read.parquet("/root/testdata/sf0.001/code_files.parquet")
    calls = []

    def counting(records):
        calls.append(1)
        return judge.rubric_judge(records)

    out = dataset(files, str(tmp_path), Settings(n_train=5, n_val=2), counting).collect()
    assert out and {r.split for r in out} >= {"train"} and len(calls) == len(judge.ORDER)
    text = {r.fileId: r.content for r in files.collect()}
    assert all(text[r.id][r.location_start : r.location_end] == r.value for r in out)
    assert len(dataset(files, str(tmp_path), Settings(n_train=5, n_val=2), counting).collect()) == len(out) and len(calls) == len(judge.ORDER)
