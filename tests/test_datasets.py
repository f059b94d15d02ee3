import pytest

from corpusloom.sources import datasets as DS


def test_splits_and_languages_prune_folders(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "en", "train"), (2, "en", "test"), (3, "de", "train"), (4, "fr", "train")], "k long, language string, split string"
    )
    path = str(tmp_path / "d")
    DS.write_partitioned(df, path, ["language", "split"])
    got = DS.read_languages(spark, path, ("en", "de"), "train")
    assert sorted(r.k for r in got.collect()) == [1, 3]
    assert "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString()
    assert [r.k for r in DS.read_dataset(spark, path, split="test").collect()] == [2]
    with pytest.raises(ValueError, match="no configurations"):
        DS.read_dataset(spark, path, config="x")


def test_examples_are_kept_unless_forced(spark, tmp_path):
    path = str(tmp_path / "e")
    DS.write_examples(spark.range(3), path)
    DS.write_examples(spark.range(5), path)
    assert DS.read_examples(spark, path).count() == 3
    DS.write_examples(spark.range(5), path, force=True)
    assert DS.read_examples(spark, path).count() == 5


def test_packs_and_metadata(spark, tmp_path):
    packs = spark.createDataFrame([("train", 1), ("train", 2), ("test", 3)], "split string, prompt_len int")
    path = str(tmp_path / "p")
    assert not DS.packs_complete(spark, path)
    DS.write_packs(packs, path, {"context_len": 8}, ["train", "test"])
    assert DS.packs_complete(spark, path)
    assert DS.read_document(spark, f"{path}/metadata.json") == {"context_len": 8, "splits": {"train": 2, "test": 1}}
    assert DS.read_packs(spark, path, "train").count() == 2
    with pytest.raises(RuntimeError, match="no rows left in split validation"):
        DS.write_packs(packs, str(tmp_path / "q"), {}, ["train", "validation"])
    assert not DS.packs_complete(spark, str(tmp_path / "q"))


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_report_keeps_its_order(spark, tmp_path, fmt):
    df = spark.createDataFrame([("macro", 1, 0.5), ("de", 0, 0.25), ("ar", 0, 0.75)], "language string, position int, f double")
    path = str(tmp_path / fmt)
    DS.write_report(df.repartition(3), path, ["position", "language"], fmt)
    text = spark.read.text(path).collect()
    assert len(text) == (4 if fmt == "csv" else 3)
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    assert [r.language for r in reader.format(fmt).load(path).collect()] == ["ar", "de", "macro"]
    with pytest.raises(ValueError):
        DS.write_report(df, path, ["position"], "xml")
