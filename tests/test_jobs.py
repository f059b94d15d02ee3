import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import __main__ as cli
from corpusloom.functions import python as PY
from corpusloom.operators import vocabulary as V
from corpusloom.plans import display as D
from corpusloom.plans import jobs as J
from corpusloom.sources import datasets as DS, examples as EX, shards as SH


@pytest.fixture(scope="module")
def word_tokenizer(tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = ["[UNK]", "<eos>", *"abcdefg", "Article", ":"]
    tokenizer = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path_factory.mktemp("tok") / "tokenizer.json")
    tokenizer.save(path)
    return path, tokenizer


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    for i, size in enumerate((5, 0, 7)):
        spark.range(i * 100, i * 100 + size).coalesce(1).write.parquet(str(tmp_path / f"part={i}"))
    got = DS.read_numbered(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(12))
    assert [r.id for r in got] == [*range(5), *range(200, 207)]


def test_numbering_moves_no_text_however_many_files(spark, tmp_path, monkeypatch):
    for i in range(5):
        frame = spark.range(i * 10, i * 10 + 4).selectExpr("id", "concat('text ', id) AS text")
        frame.coalesce(1).write.parquet(str(tmp_path / f"part={i}"))
    for most in (250_000, 2):
        monkeypatch.setattr(DS, "FILES_PER_JOIN", most)
        got = DS.read_numbered(spark, str(tmp_path))
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert [(r.doc_id, r.id, r.part) for r in got.orderBy("doc_id").collect()] == [
            (4 * i + k, 10 * i + k, i) for i in range(5) for k in range(4)
        ]


def test_preprocess_reads_one_split_and_json(spark, tmp_path):
    rows = [(i, "train" if i % 2 else "test", "a b c") for i in range(10)]
    df = spark.createDataFrame(rows, "n long, split string, text string")
    DS.write_partitioned(df, str(tmp_path / "in"), ["split"])
    out = str(tmp_path / "shards")
    cli.main(["preprocess", "--dataset", str(tmp_path / "in"), "--output_dir", out, "--shard_size", "8"])
    assert SH.scan_shard_headers(spark, out).agg(F.sum("tokens")).first()[0] == 5 * 4
    df.write.json(str(tmp_path / "json"))
    command = ["preprocess", "--dataset", str(tmp_path / "json"), "--output_dir", out, "--format", "json"]
    cli.main([*command, "--key", "n"])
    assert SH.scan_shard_headers(spark, out).agg(F.sum("tokens")).first()[0] == 5 * 4
    with pytest.raises(SystemExit, match="--key"):
        cli.main(command)


def test_preprocess_and_count_from_the_command_line(spark, tmp_path, word_tokenizer):
    path, tokenizer = word_tokenizer
    texts = ["a b", "", "c d e f g a", "b", "a a a"]
    spark.createDataFrame([(t,) for t in texts], "body string").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "shards")
    cli.main(
        ["preprocess", "--dataset", str(tmp_path / "in"), "--text_field", "body", "--output_dir", out,
         "--tokenizer", path, "--shard_size", "6"]
    )
    stream = [t for text in texts for t in [1, *tokenizer.encode(text).ids]]
    got = []
    for r in SH.read_token_shards(spark, out).orderBy("shard_index", "lo").collect():
        got += r.ids
    assert got == stream
    per_file, plan = J.count_training_tokens(spark, out, 2, 10)
    assert {r.file: r.tokens for r in per_file.collect()}[None] == len(stream) - 6
    assert plan.first().iterations == round((len(stream) - 6) * 2 / 10)
    cli.main(["count-tokens", "--data_dir", out])
    cli.main(["count-tokens", "--data_dir", out, "--setup", "small", "--epochs", "2"])


def test_packs_are_built_once_and_balanced(spark, tmp_path, word_tokenizer):
    path, tokenizer = word_tokenizer
    data = [
        (i, "en" if i % 3 else "de", "train" if i < 30 else "test" if i < 36 else "validation", "a b " * i, "c")
        for i in range(42)
    ]
    rows = spark.createDataFrame(data, "doc_id long, language string, split string, text string, summary string")
    out = str(tmp_path / "packs")
    code = J.column_coder(PY.encoder(PY.tokenizer_json(spark, path)))
    built = J.build_packs(rows, code, out, "text", ["en", "de"], 1, "balanced", 16, 4)
    train = built.where("split = 'train'").collect()
    assert len(train) == 40 and sum(r.language == "de" for r in train) == 20
    assert sorted(r.out_pos for r in train) == list(range(40))
    for r in train:
        prompt = f"[LANG={r.language}] Summarize the following article.\nArticle:\n{'a b ' * r.doc_id}\nSummary:\n"
        ids = tokenizer.encode(prompt).ids[:14]
        assert r.input_ids == [*ids, 4, 1] and r.labels == [-100] * len(ids) + [4, 1]
    meta = DS.read_document(spark, f"{out}/metadata.json")
    assert meta["splits"] == {"train": 40, "validation": 6, "test": 6} and meta["mix_mode"] == "balanced"
    again = J.build_packs(rows.limit(0), code, out, "text", ["en", "de"], 1)
    assert again.count() == 52


@pytest.mark.parametrize("mode", ["natural", "balanced"])
def test_packs_of_languages_with_equal_keys(spark, tmp_path, word_tokenizer, mode):
    path, _ = word_tokenizer
    data = [(i, g, split, f"{w} " * (i + 1), "c") for g, w in (("en", "a"), ("de", "b")) for i, split in enumerate(["train"] * 5 + ["test", "validation"])]
    rows = spark.createDataFrame(data, "doc_id long, language string, split string, text string, summary string")
    code = J.column_coder(PY.encoder(PY.tokenizer_json(spark, path)))
    built = J.build_packs(rows, code, str(tmp_path / mode), "text", ["en", "de"], 1, mode, 16, 4, fraction=0.8)
    train = built.where("split = 'train'").collect()
    assert sorted(r.out_pos for r in train) == list(range(8))
    assert sorted(r.language for r in train) == ["de"] * 4 + ["en"] * 4
    meta = DS.read_document(spark, f"{tmp_path}/{mode}/metadata.json")
    assert meta["splits"] == {"train": 8, "validation": 2, "test": 2}
    assert {"dataset_repo", "tokenizer_json", "eos_id", "mix_mode"} <= set(meta)


def test_packs_from_the_command_line_count_the_chosen_form(spark, tmp_path):
    data = [(i, "en", s, "x x", "x", "kato mira", "solo") for i, s in enumerate(["train", "train", "test", "validation"])]
    schema = "doc_id long, language string, split string, text string, summary string, text_romanized string, summary_romanized string"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))
    cli.main(
        ["build-packs", "--dataset", str(tmp_path / "in"), "--output_dir", str(tmp_path / "out"), "--representation", "romanized",
         "--languages", "en", "--mix_mode", "natural", "--context_len", "64"]
    )
    packs = DS.read_packs(spark, str(tmp_path / "out")).collect()
    assert len(packs) == 4 and not any(V.UNK in r.input_ids for r in packs)


def test_stored_predictions_from_the_command_line(spark, tmp_path, monkeypatch):
    rows = [(0, 0, [2.0, 1.0]), (1, 0, [1.0, 0.5]), (1, 1, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "label long, pred long, logits array<double>")
    df.write.parquet(str(tmp_path / "good"))
    df.drop("label").write.parquet(str(tmp_path / "bare"))
    names = ",".join(str(tmp_path / n) for n in ("good", "bare", "absent"))
    cli.main(["evaluate", "--datasets", names, "--labels", "One,Two,Three", "--output_dir", str(tmp_path / "out")])
    document = DS.read_document(spark, str(tmp_path / "out" / "evaluation.json"))
    assert document["skipped"]["Two"] == "lacks label" and document["skipped"]["Three"].startswith("cannot be read")
    one = document["datasets"]["One"]
    nll = [np.log(np.exp(x).sum()) - x[y] for y, _, x in rows]
    assert (one["examples"], one["accuracy"]) == (3, pytest.approx(2 / 3)) and one["loss"] == pytest.approx(np.mean(nll))
    assert one["confusion"] == [[0, 0, 1], [1, 0, 1], [1, 1, 1]] and one["classes"]["1"]["precision"] == 1.0
    assert spark.read.parquet(str(tmp_path / "out" / "predictions")).count() == 3
    monkeypatch.setattr(J, "DOCUMENT_CELLS", 2)
    many = J.evaluate_predictions({"a": lambda: df}, str(tmp_path / "many"))
    assert "confusion" not in many["datasets"]["a"] and "many classes, see the tables" in D.evaluation_text(many)
    assert spark.read.json(many["tables"]["classes"]).count() == 2
    with pytest.raises(ValueError, match="1 datasets but 2 labels"):
        J.evaluate_predictions({"a": lambda: df}, str(tmp_path / "no"), ["x", "y"])


def test_classifier_evaluation_skips_what_lacks_columns(spark, tmp_path, word_tokenizer):
    path, _ = word_tokenizer
    rows = spark.createDataFrame([(0, "a", "b", 0), (1, "c", None, 1), (2, "b", "g", 1)], "doc_id long, p string, h string, y int")

    def load():  # class 1 if the first id is above that of "b"
        return lambda m: np.stack([np.zeros(len(m)), m[:, 0] - 3.5], axis=1)

    predictions, report, skipped = J.evaluate_classifier(
        {"one": rows, "two": rows.drop("y"), "three": rows.where("y = 1")},
        J.column_coder(PY.encoder(PY.tokenizer_json(spark, path))), PY.scorer(load), ["p", "h"], "y", 4, str(tmp_path / "out"),
    )
    assert skipped == {"two": ["y"]}
    assert {(r.dataset, r.doc_id): r.pred for r in predictions.collect()} == {
        ("one", 0): 0, ("one", 1): 1, ("one", 2): 0, ("three", 1): 1, ("three", 2): 0,
    }
    got = {(r.dataset, r.label): (r.precision, r.recall) for r in report.collect()}
    assert got[("one", 0)] == (0.5, 1.0) and got[("three", 0)] == (0.0, 0.0) and got[("three", 1)] == (1.0, 0.5)
    cells = spark.read.json(str(tmp_path / "out" / "confusion"))
    assert cells.count() == 5 and cells.agg(F.sum("n")).first()[0] == 5


def test_datasets_are_scored_from_the_command_line(spark, tmp_path, word_tokenizer, capsys):
    path, _ = word_tokenizer
    (tmp_path / "own_scores.py").write_text(
        "import numpy as np\n\n\ndef load():\n    return lambda m: np.stack([np.zeros(len(m)), m[:, 0] - 3.5], axis=1)\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "own_scores.py"))
    data = [("a", "b", 0, "test"), ("c", None, 1, "test"), ("b", "g", 1, "test"), ("a", "a", 1, "train")]
    rows = spark.createDataFrame(data, "p string, h string, y int, split string")
    DS.write_partitioned(rows.coalesce(1), str(tmp_path / "rows"), ["split"])
    rows.drop("h").write.parquet(str(tmp_path / "bare"))
    rows.limit(0).write.parquet(str(tmp_path / "none"))
    names = ",".join(str(tmp_path / n) for n in ("rows", "bare", "absent", "none"))
    command = [
        "evaluate", "--datasets", names, "--output_dir", str(tmp_path / "out"), "--scorer", "own_scores:load", "--label_column", "y",
        "--text_columns", "p,h", "--context_window", "4",
    ]
    with pytest.raises(SystemExit, match="--tokenizer"):
        cli.main(command)
    with pytest.raises(SystemExit, match="--key"):
        cli.main([*command, "--tokenizer", path, "--format", "json"])
    cli.main([*command, "--tokenizer", path])
    document = DS.read_document(spark, str(tmp_path / "out" / "evaluation.json"))
    assert document["skipped"]["none"] == "has no rows" and spark.read.json(document["tables"]["confusion"]).count() == 3
    assert document["skipped"]["bare"] == "lacks h" and document["skipped"]["absent"].startswith("cannot be read")
    one = document["datasets"]["rows"]
    assert set(document["datasets"]) == {"rows"} and (one["examples"], one["accuracy"]) == (3, pytest.approx(2 / 3))
    margins = [-1.5, 0.5, -0.5]  # score of class 1; class 0 has 0
    nll = [np.log1p(np.exp(m)) - m * y for m, (_, _, y, _) in zip(margins, data)]
    assert one["loss"] == pytest.approx(np.mean(nll)) and one["confusion"] == [[0, 0, 1], [1, 0, 1], [1, 1, 1]]
    shown = capsys.readouterr().out
    assert "bare skipped: lacks h" in shown and "accuracy: 0.6667 (66.67 %)" in shown and "  1: 0.5000 (50.00 %)" in shown
    with pytest.raises(ValueError, match="not module:function"):
        PY.named_loader("own_scores")
    with pytest.raises(ValueError, match="no usable dataset.*absent"):
        J.evaluate_scored({"absent": lambda: spark.read.parquet(str(tmp_path / "no"))}, None, None, ["p"], "y", 4, str(tmp_path / "x"))


def test_evaluation_as_text():
    means = {f"{m}_{s}": 0.5 for m in ("macro", "weighted") for s in ("precision", "recall", "f1", "f2")}
    own = {"precision": 0.5, "recall": 0.25, "f1": 1 / 3, "f2": 0.2777, "support": 4}
    metrics = {"examples": 4, "accuracy": 0.25, "loss": None, **means, "classes": {"0": own, "10": own}, "confusion": [[0, 10, 3], [10, 10, 1]]}
    lines = D.evaluation_text({"datasets": {"One": metrics}, "skipped": {"Two": "lacks y"}}).splitlines()
    assert lines[0] == "Two skipped: lacks y" and "  mean loss: -" in lines
    at = lines.index("confusion (lines: true class, columns: predicted)")
    assert lines[at + 1 : at + 4] == ["      0  10", "   0  0   3", "  10  0   1"]
    assert lines[at + 5] == "  0: 0.2500 (25.00 %)" and lines[-1].split() == ["One", "4", "0.2500", "(25.00", "%)", "0.5000", "0.5000", "0.5000"]
    many = metrics | {"classes": {str(i): own for i in range(D.CLASSES_SHOWN + 7)}}
    text = "\n".join(D.dataset_lines("Many", many))
    assert "and 7 more classes" in text and f"{D.CLASSES_SHOWN + 7} classes, see the tables" in text
    empty = {k: v for k, v in metrics.items() if k not in ("classes", "confusion")} | {"examples": 0, "accuracy": None}
    assert "  accuracy: -" in D.dataset_lines("Empty", empty)


def test_generation_report_files(spark, tmp_path):
    rows = spark.createDataFrame(
        [(0, "en", "a b c d", "a b c d"), (1, "en", "x", "y"), (2, "de", "a b c d e", "a b c d e")],
        "doc_id long, language string, prediction string, reference string",
    )
    rows.write.parquet(str(tmp_path / "gen"))
    cli.main(["evaluate-generation", "--generated", str(tmp_path / "gen"), "--output_dir", str(tmp_path / "out")])
    got = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out" / "csv")).collect()
    assert [r.language for r in got] == ["de", "en", "macro", "weighted"]
    assert got[1].rougeL == 0.5 and got[2].rouge1 == 0.75 and got[3].rouge1 == pytest.approx(2 / 3) and got[3].num_examples == 3
    first = J.evaluate_generation(rows, rows_per_language=1).where("language = 'en'").first()
    assert (first.num_examples, first.rouge1) == (1, 1.0)
    document = DS.read_document(spark, str(tmp_path / "out" / "report.json"))
    assert set(document["per_language"]) == {"de", "en"} and document["macro"]["rouge1"] == 0.75
    assert document["parameters"] == {"split": "test", "rows_per_language": 0, "ascii_only": False}
    tokens = [(0, "en", 5, -1.0), (0, "en", 6, -3.0), (2, "de", 5, -7.0), (2, "de", -100, 0.0)]
    spark.createDataFrame(tokens, "doc_id long, language string, label int, logp double").write.parquet(str(tmp_path / "scores"))
    cli.main(
        ["evaluate-generation", "--generated", str(tmp_path / "gen"), "--output_dir", str(tmp_path / "out2"),
         "--token_scores", str(tmp_path / "scores")]
    )
    document = DS.read_document(spark, str(tmp_path / "out2" / "report.json"))
    losses = {name: line["token_loss"] for name, line in document["per_language"].items()}
    assert losses == {"de": 7.0, "en": 2.0} and document["macro"]["token_loss"] == 4.5


def test_loss_counts_the_evaluated_rows_only(spark):
    texts = [(0, "en", "a", "a"), (1, "en", "a", "b"), (0, "de", "a", "a")]
    rows = spark.createDataFrame(texts, "doc_id long, language string, prediction string, reference string")
    tokens = [(0, "en", 5, -1.0), (0, "en", 6, -3.0), (1, "en", 5, -50.0), (0, "de", 5, -7.0)]
    scores = spark.createDataFrame(tokens, "doc_id long, language string, label int, logp double")
    got = {r.language: r.token_loss for r in J.evaluate_generation(rows, scores, 1).collect()}
    assert got["en"] == 2.0 and got["de"] == 7.0
    assert {r.language: r.token_loss for r in J.evaluate_generation(rows, scores).collect()}["en"] == 18.0


def test_staged_tables_of_a_job_go_when_it_ends(spark, tmp_path):
    from corpusloom.session import checkpoint_root

    root = checkpoint_root(spark).removeprefix("file://")
    docs = spark.createDataFrame([(0, "a b"), (1, "b")], "doc_id long, text string")
    vocab = V.build_vocab(docs).collect()
    table = spark.createDataFrame(vocab)
    before = set(os.listdir(root))
    J.corpus_to_shards(docs, J.vocabulary_coder(table), str(tmp_path / "s"), V.EOT, 10, shard_size=3)
    assert not [f for f in set(os.listdir(root)) - before if f.startswith("encoded")]


def test_example_files(spark, tmp_path, monkeypatch):
    data = [(i, [i, 2 * i, -1], i % 3) for i in range(50)]
    df = spark.createDataFrame(data, "k long, input_ids array<int>, label int")
    path = str(tmp_path / "ex")
    EX.write_example_files(df.repartition(4), path, 3, "k", rows_per_file=20)
    assert len(os.listdir(path)) == 3
    got = EX.read_example_files(spark, path, 3).orderBy("file", "row").collect()
    assert [(r.input_ids, r.label) for r in got] == [(ids, y) for _, ids, y in data]
    EX.write_example_files(df.limit(1), path, 3, "k")
    assert EX.read_example_files(spark, path, 3).count() == 50  # kept
    EX.write_example_files(df.where("k < 5"), path, 3, "k", force=True)
    assert EX.read_example_files(spark, path, 3).count() == 5
    one = tmp_path / "train.bin"
    ids, labels = np.arange(12, dtype="<i4").reshape(4, 3), np.array([1, 0, 2, 1], "<i8")
    one.write_bytes(np.array([4], "<i4").tobytes() + ids.tobytes() + labels.tobytes())
    got = EX.read_example_files(spark, str(one), 3).orderBy("row").collect()
    assert [(r.input_ids, r.label) for r in got] == [(row.tolist(), int(y)) for row, y in zip(ids, labels)]
    with pytest.raises(Exception, match="does not fit rows of 5 ids"):
        EX.read_example_files(spark, str(one), 5).collect()
    with pytest.raises(Exception, match="rows must have 4 ids"):
        EX.write_example_files(df, str(tmp_path / "bad"), 4, "k")


def test_predicate(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "n int, s string")
    odd = PY.predicate(lambda n, s: s is not None and len(s) == n)
    assert [r.n for r in df.where(odd("n", "s")).orderBy("n").collect()] == [1, 2]


def test_vocabulary_coder_matches_tokenizer_path(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "b")], "doc_id long, text string")
    vocab = V.build_vocab(docs, 10)
    got = J.vocabulary_coder(vocab)(docs, {"ids": F.col("text")}, ["doc_id"], first={"ids": 1})
    assert {r.doc_id: r.ids for r in got.collect()} == {0: [4], 1: [3]}


def test_small_shards_share_a_writing_task(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c") for i in range(30)], "doc_id long, text string")
    vocab = spark.createDataFrame(V.build_vocab(docs).collect())
    used, write = [], SH.write_token_shards
    monkeypatch.setattr(SH, "write_token_shards", lambda rows, path, version, tasks: used.append(tasks) or write(rows, path, version, tasks))
    headers = J.corpus_to_shards(docs, J.vocabulary_coder(vocab), str(tmp_path / "s"), V.EOT, 10, shard_size=7).collect()
    assert used == [1]  # 120 ids do not need a task for each of 18 shards
    assert sorted(r.tokens for r in headers) == [1] + [7] * 17
