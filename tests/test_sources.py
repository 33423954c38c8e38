import pytest
from pyspark.ml.linalg import Vectors

from cohortspark.sources import (
    checkpoint_or_reload,
    durable,
    feature_set_path,
    infer_table_name,
    published_counts,
    read_csv_table,
    read_dictionary_ids,
    read_dictionary_text,
    read_feature_sets,
    read_libsvm,
    read_typed_csv,
    remove_old_runs,
    report_metrics,
    shared_folder,
    sweep_feature_sets,
    write_feature_sets,
    write_libsvm,
)
from cohortspark.sources.checkpoints import child_folders, path_exists, published_run, release, saved_rows


@pytest.mark.parametrize(
    "path, name",
    [
        ("data/PATIENTS.csv", "PATIENTS"),
        ("PATIENTS", "PATIENTS"),
        ("a/X.CSV", "CSV"),
        ("a/x.csv.gz", "gz"),
        ("a/b-c.csv", "c"),
        ("a/!", "a/!"),
    ],
)
def test_table_names(path, name):
    assert infer_table_name(path) == name


def test_csv_with_and_without_schema(spark, tmp_path, rows):
    file = tmp_path / "SMALL.csv"
    file.write_text("id,name,at\n1,a,2020-01-01 00:00:00\n2,,\n")
    read_csv_table(spark, str(file))
    assert dict(spark.table("SMALL").dtypes)["id"] == "int"
    typed = read_csv_table(spark, str(file), "id BIGINT, name STRING, at TIMESTAMP_NTZ", view="other")
    assert typed.dtypes == [("id", "bigint"), ("name", "string"), ("at", "timestamp_ntz")]
    assert rows(spark.table("other"), "id", "name") == [(1, "a"), (2, None)]


def test_dictionaries(spark, tmp_path, rows):
    words = tmp_path / "words.txt"
    words.write_text("Abc\nabc\nDEF\n")
    assert rows(read_dictionary_text(spark, str(words))) == [("abc",), ("def",)]
    items = tmp_path / "items.csv"
    items.write_text("itemid,label\n5,x\n5,y\n7,z\n")
    assert rows(read_dictionary_ids(spark, str(items))) == [(5,), (7,)]


def test_checkpoint_is_built_once_and_again_on_demand(spark, rows):
    path, built = shared_folder(spark), []

    def step(name, frame):
        def build(done):
            built.append((name, sorted(done)))
            return frame()

        return build

    steps = {"a": step("a", lambda: spark.range(3)), "b": step("b", lambda: spark.range(2))}
    checkpoint_or_reload(spark, path, steps)
    tables = checkpoint_or_reload(spark, path, steps)
    assert built == [("a", []), ("b", ["a"])]
    assert rows(tables["a"]) == [(0,), (1,), (2,)] and rows(tables["b"]) == [(0,), (1,)]
    checkpoint_or_reload(spark, path, steps, reload=True)
    assert len(built) == 4


def test_tables_of_different_runs_are_never_mixed(spark, rows):
    path = shared_folder(spark)

    def steps(n, fails=False):
        def second(done):
            if fails:
                raise RuntimeError("interrupted")
            return spark.range(n)

        return {"a": lambda done: spark.range(n), "b": second}

    with pytest.raises(RuntimeError):
        checkpoint_or_reload(spark, path, steps(1, fails=True))
    checkpoint_or_reload(spark, path, steps(2))
    with pytest.raises(RuntimeError):
        checkpoint_or_reload(spark, path, steps(3, fails=True), reload=True)
    kept = checkpoint_or_reload(spark, path, steps(4))
    assert kept["a"].count() == kept["b"].count() == 2
    new = checkpoint_or_reload(spark, path, steps(5), reload=True)
    assert new["a"].count() == new["b"].count() == 5
    more = {**steps(6), "c": lambda done: spark.range(6)}
    assert checkpoint_or_reload(spark, path, more)["a"].count() == 6


def test_durable_tables_live_in_the_shared_folder(spark, rows):
    df = durable(spark.range(4).repartition(3))
    assert rows(df) == [(0,), (1,), (2,), (3,)]
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is not None:
        assert all(base in f for f in df.inputFiles())
    assert not path_exists(spark, shared_folder(spark))


def test_libsvm_keeps_labels_and_values(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 1.0, Vectors.sparse(12, [0, 11], [2.0, 0.5])), (2, 0.0, Vectors.dense([0.0] * 11 + [1.0]))],
        ["key", "label", "features"],
    )
    base = str(tmp_path)
    for hours in (1, 8):
        write_libsvm(df, feature_set_path(base, 24, hours))
    got = read_libsvm(spark, feature_set_path(base, 24, 8)).collect()
    assert {(r.label, tuple(r.features.toArray())) for r in got} == {
        (1.0, (2.0, *[0.0] * 10, 0.5)), (0.0, (*[0.0] * 11, 1.0)),
    }
    swept = sweep_feature_sets(spark, f"{base}/svmoutput24")
    assert [w for w, _ in swept] == [1, 8] and all(s.count() == 2 for _, s in swept)
    assert feature_set_path("x", 24, 2, "mean") == "x/svmoutput24/aggfeatures2hour"


def test_feature_sets_of_a_sweep_are_read_by_partition(spark, tmp_path, rows):
    path = str(tmp_path / "swept")
    df = spark.createDataFrame([(1, 1, 0.5), (2, 8, 1.5)], "key int, pred_hours int, x double")
    write_feature_sets(df, path)
    assert rows(read_feature_sets(spark, path), "key") == [(1,), (2,)]
    one = read_feature_sets(spark, path, 8)
    assert rows(one, "key", "pred_hours", "x") == [(2, 8, 1.5)]
    scan = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
    assert "pred_hours" in scan.split("]")[0]


def test_reports_are_stacked_and_saved(spark, tmp_path, rows):
    part = spark.createDataFrame([("m", "auroc", 0.5)], "model string, metric string, value double")
    report_metrics([part, part], str(tmp_path / "report"))
    assert rows(spark.read.parquet(str(tmp_path / "report"))) == [("m", "auroc", 0.5)] * 2


def test_rows_are_published_with_a_run_and_old_runs_go(spark, rows):
    path = shared_folder(spark)
    assert rows(published_counts(spark, path)) == [] and remove_old_runs(spark, path, 1) == []
    for n in (1, 2, 3):
        tables = checkpoint_or_reload(spark, path, {"a": lambda done: spark.range(n), "b": lambda done: done["a"].where("id > 0")}, reload=True, keep=2)
        assert rows(published_counts(spark, path)) == [("a", n), ("b", n - 1)]
        assert tables["a"].count() == n  # never removed before the next run is published
    left = [f.rsplit("/", 1)[-1] for f in child_folders(spark, path)]
    assert len([f for f in left if f.startswith("run-")]) == 2 and published_run(spark, path, ["a", "b"]) in left
    with pytest.raises(ValueError):
        remove_old_runs(spark, path, 0)


def test_rows_of_a_saved_table_are_counted_without_reading_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id * 2 AS twice").write.parquet(path)
    assert saved_rows(spark, path) == 1000
    plan = spark.read.parquet(path).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_release_removes_what_durable_made_only(spark, tmp_path):
    table = durable(spark.range(5))
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    release(table)
    assert not path_exists(spark, folder)
    spark.range(5).write.parquet(str(tmp_path / "mine"))
    with pytest.raises(ValueError):
        release(spark.read.parquet(str(tmp_path / "mine")))


def test_typed_columns_by_name_and_rejected_lines(spark, tmp_path, rows):
    file = tmp_path / "MIXED.csv"
    file.write_text(
        "ROW_ID,name,id,at,other\n"
        '1,"a, b",10,2020-01-01 00:00:00,x\n'
        "2,,20,,\n"
        "3,c,thirty,2020-01-01 00:00:00,x\n"
        "4,d,40\n"
        "5,e,50,2020-01-02 00:00:00,x,y\n"
        "6,f,60,not a time,x\n"
    )
    good, rejected = read_typed_csv(spark, str(file), {"id": "INT", "at": "TIMESTAMP", "name": "STRING"})
    assert good.dtypes == [("id", "int"), ("at", "timestamp"), ("name", "string")]
    assert [(r.id, r.name) for r in good.orderBy("id").collect()] == [(10, "a, b"), (20, None)]
    assert sorted(r.line[0] for r in rejected.collect()) == ["3", "4", "5", "6"]
    assert rows(spark.table("MIXED"), "id") == [(10,), (20,)]
    with pytest.raises(ValueError):
        read_typed_csv(spark, str(file), {"missing": "INT"})


def test_one_window_of_a_sweep_is_replaced(spark, tmp_path, rows):
    path = str(tmp_path / "swept")
    write_feature_sets(spark.createDataFrame([(1, 1, 0.5), (2, 8, 1.5), (3, 8, 2.5)], "key int, pred_hours int, x double"), path)
    write_feature_sets(spark.createDataFrame([(4, 8, 9.5)], "key int, pred_hours int, x double"), path, only_these=True)
    assert rows(read_feature_sets(spark, path), "key", "pred_hours") == [(1, 1), (4, 8)]
