import pytest

from linkweave.sources import tables


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_empty_fields_quotes_and_tabs(spark, tmp_path):
    p = write(tmp_path / "s.tsv", 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "quoted\t\tUS\nS1-2\t"\t1 Main\t\n')
    rows = sorted(map(tuple, tables.read_source(spark, p, "1").collect()))
    assert rows == [("S1-1", 'A "quoted', "", "US"), ("S1-2", '"', "1 Main", "")]
    with pytest.raises(ValueError):
        tables.read_source(spark, p, "4")


def test_truth(spark, tmp_path):
    p = write(tmp_path / "t.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,\nS1-2\t\nS1-3\tnan\n")
    rows = {r.s1_id: r.ids for r in tables.read_truth(spark, p, empty_words=True).collect()}
    assert rows == {"S1-1": ["S2-1", "S3-2"], "S1-2": [], "S1-3": []}
    assert tables.truth_links(tables.read_truth(spark, p)).count() == 3


def test_results_round_trip(spark, tmp_path):
    heads = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    pairs = spark.createDataFrame([("S1-1", "S3-9", 0), ("S1-1", "S2-1", 1), ("S1-1", "S3-9", 2)], "s1_id string, cand_id string, rank int")
    rows = tables.result_rows(heads, pairs)
    tables.write_tsv(rows, str(tmp_path / "out"))
    back = {r.s1_id: r.ids for r in tables.read_truth(spark, str(tmp_path / "out")).collect()}
    assert back == {"S1-1": ["S3-9", "S2-1"], "S1-2": []}


def test_scoreboard(spark, tmp_path):
    path = str(tmp_path / "board")
    assert tables.scoreboard(spark, path).count() == 0
    tables.log_experiment(spark, path, experiment_id="x", macro_f05=0.123456, runtime_s=1.239)
    tables.log_experiment(spark, path, experiment_id="y")
    rows = {r.experiment_id: r for r in tables.scoreboard(spark, path).collect()}
    assert rows["x"].macro_f05 == 0.1235 and rows["x"].runtime_s == 1.24 and rows["y"].macro_f05 is None


def test_cached_lookup_and_digests(spark, tmp_path):
    made = []
    compute = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "c"), compute).count() == 3
    assert made == [1]
    p = write(tmp_path / "s.tsv", "entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta\t\t\nS1-1\tb\t\t\n")
    assert [r.business_name for r in tables.read_lookup(spark, p).collect()] == ["b"]
    tables.normalize_files(spark, p, str(tmp_path / "n"), lambda df: df)
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2
    import hashlib

    assert tables.file_digests(spark, p).first().sha256 == hashlib.sha256((tmp_path / "s.tsv").read_bytes()).hexdigest()


def test_values_without_a_column_are_metadata(spark, tmp_path):
    path = str(tmp_path / "board")
    tables.log_experiment(spark, path, experiment_id="x", seed=42, note="a")
    tables.log_experiment(spark, path, experiment_id="y", timestamp="2020-01-01 00:00:00")
    rows = {r.experiment_id: r for r in tables.scoreboard(spark, path).collect()}
    assert rows["x"].metadata == {"seed": "42", "note": "a"} and len(rows["x"].timestamp) == 19 and rows["y"].timestamp == "2020-01-01 00:00:00"


def test_registry_passes_over_what_is_broken(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert tables.runs(spark, path).count() == 0
    tables.log_run(spark, path, "first", f05=0.5, kept=True)
    tables.log_run(spark, path, "second", n=3)
    (tmp_path / "runs" / "broken.txt").write_text("{not json\n[]\n\n")
    rows = {r.experiment: r for r in tables.runs(spark, path).collect()}
    assert rows["first"].result == {"f05": "0.5", "kept": "true"} and rows["second"].result == {"n": "3"} and rows["first"].timestamp


def test_reports_are_tables_and_lines(spark, tmp_path):
    tables.write_report(spark.createDataFrame([("a", 0.5), ("b", None)], "strategy string, recall double"), str(tmp_path / "r"), "BLOCKING")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r" / "summary")).collect())
    assert "BLOCKING\n========" in text and "  strategy: a\n  recall: 0.5" in text and "  recall: \n" in text + "\n"
    assert spark.read.csv(str(tmp_path / "r" / "table"), header=True).count() == 2


def test_splits_are_stored_and_read_again(spark, tmp_path):
    heads = spark.createDataFrame([(f"S1-{i}",) for i in range(60)], "s1_id string")
    links = spark.createDataFrame([(f"S1-{i}", f"S2-{k}") for i in range(40) for k in range(i % 5)], "s1_id string, tid string")
    path = str(tmp_path / "split")
    made = sorted(map(tuple, tables.get_or_make_split(spark, path, heads, links).collect()))
    assert made == sorted(map(tuple, tables.get_or_make_split(spark, path, heads.limit(0), links).collect())) and len(made) == 60
    truth = spark.read.parquet(f"{path}/truth")
    assert sum(len(r.ids) for r in truth.collect()) == 80 and {r.split for r in truth.collect()} == {"train", "val"}
    figures = spark.read.json(f"{path}/metadata").first()
    assert figures.total_s1 == 60 and figures.train_total_positive_links + figures.val_total_positive_links == 80 and figures.leakage_check == "PASSED" and figures.created_at
    assert sum(int(x.split(":")[1]) for x in figures.train_distribution.split(",")) == figures.train_s1


def test_files_are_copied_once(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "models").mkdir(parents=True)
    (a / "models" / "m.bin").write_bytes(b"123")
    (a / "r.txt").write_text("report")
    assert tables.status(spark, str(b)) == (0, 0)
    assert tables.sync(spark, str(a), str(b)) == ["models/m.bin", "r.txt"] and tables.sync(spark, str(a), str(b)) == []
    (a / "r.txt").write_text("report 2")
    assert tables.sync(spark, str(a), str(b)) == ["r.txt"] and (b / "r.txt").read_text() == "report 2"
    assert tables.status(spark, str(b))[0] >= 2


def test_tables_that_broke_off_are_made_anew(spark, tmp_path):
    path = tmp_path / "c"
    tables.cached(spark, str(path), lambda: spark.range(3))
    (path / "_SUCCESS").unlink()
    assert tables.cached(spark, str(path), lambda: spark.range(5)).count() == 5
