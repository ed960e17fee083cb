import io
import os
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from tabulon.operators import report, runlog, score
from tabulon.sources import infer, readers, sinks


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return str(path)


def jobs_of(spark, action):
    """How many Spark jobs ``action`` runs."""
    group = f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_types_of_many_columns_take_one_parse(spark, tmp_path):
    kinds = {"bigint": ["1", " -2 ", "+3"], "double": ["1", "2.5", "1e3"], "boolean": ["True", "false", "TRUE"], "string": ["1", "x", "true"],
             "gaps": ["1", "", "2"], "flags": ["true", "NA", "false"], "none": ["", "NULL", "nan"], "large": ["1", "9" * 25, "2"], "mixed": ["true", "1", "0"]}
    names = [(k, i) for i in range(8) for k in kinds]
    rows = [",".join(f"{k}_{i}" for k, i in names)] + [",".join(kinds[k][r] for k, _ in names) for r in range(3)]
    (tmp_path / "wide.csv").write_text("\n".join(rows) + "\n")
    df = spark.read.option("header", True).csv(str(tmp_path / "wide.csv"))
    want = {"bigint": "bigint", "double": "double", "boolean": "boolean", "string": "string", "gaps": "double", "flags": "string", "none": "double", "large": "double", "mixed": "string"}
    assert infer.infer_types(df) == {f"{k}_{i}": want[k] for k, i in names}
    one = jobs_of(spark, lambda: infer.infer_types(df.select("bigint_0")))
    assert jobs_of(spark, lambda: infer.infer_types(df)) == one  # 72 columns as few as one
    assert set(infer.infer_types(df.filter("bigint_0 = 'none'")).values()) == {"double"}


def test_csv_types(spark, tmp_path):
    text = (
        'i,gap,f,b,bgap,d,s,none,mixed\n'
        '1,1,1.5,True,True,2024-01-01,"a ""q"", x",NA,1\n'
        '2,NA,2,False,,2024-01-02,b,,x\n'
        '-3,3,1e3,True,False,2024-01-03,N/A,null,2\n'
    )
    df = readers.read_file(spark, write(tmp_path / "t.CSV", text))
    assert dict(df.dtypes) == {
        "i": "bigint", "gap": "double", "f": "double", "b": "boolean", "bgap": "string", "d": "string", "s": "string", "none": "double", "mixed": "string",
    }
    rows = df.collect()
    assert [r["f"] for r in rows] == [1.5, 2.0, 1000.0] and rows[0]["s"] == 'a "q", x' and rows[2]["s"] is None
    assert [r["gap"] for r in rows] == [1.0, None, 3.0] and [r["none"] for r in rows] == [None] * 3


def test_all_na_tokens_fold(spark):
    df = spark.createDataFrame([(t,) for t in infer.NA_TOKENS] + [("na",), (" ",)], "s string")
    assert [r["s"] for r in infer.fold_na_columns(df).filter("s is not null").collect()] == ["na", " "]


def test_multi_line_csv(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'a,b\n1,"two\nlines"\n')
    assert readers.read_csv(spark, path).collect()[0]["b"] == "two\nlines"


def test_upload_shape(spark, tmp_path):
    path = write(tmp_path / "u.csv", "name,age,city\nAnn,30,NYC\nBob,25,LA\n")
    assert readers.shape(readers.read_file(spark, path)) == (2, 3)


def test_header_only_is_refused(spark, tmp_path):
    path = write(tmp_path / "h.csv", "col1,col2\n")
    with pytest.raises(readers.IngestionError, match="no rows or no columns"):
        readers.require_data(readers.read_file(spark, path))


def test_unknown_and_broken_files(spark, tmp_path):
    with pytest.raises(readers.IngestionError, match="files ending in .txt"):
        readers.read_file(spark, str(tmp_path / "x.txt"))
    with pytest.raises(readers.IngestionError, match="cannot read"):
        readers.read_file(spark, str(tmp_path / "missing.parquet"))


def test_json_and_parquet(spark, tmp_path):
    path = write(tmp_path / "j.json", '{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    df = readers.read_file(spark, path)
    assert df.count() == 2
    df.write.parquet(str(tmp_path / "p.parquet"))
    assert readers.read_file(spark, str(tmp_path / "p.parquet")).count() == 2


def test_parquet_scan_is_pruned_and_pushed_down(spark, sf):
    df = readers.read_parquet(spark, f"{sf}/lineitem.parquet", where=[("l_quantity", ">", 45.0)]).select("l_orderkey", "l_quantity")
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_parquet_filter_leaves_nan_out(spark, tmp_path):
    spark.createDataFrame([(1.0,), (50.0,), (float("nan"),), (None,)], "x double").write.parquet(str(tmp_path / "n.parquet"))
    assert [r["x"] for r in readers.read_parquet(spark, str(tmp_path / "n.parquet"), where=[("x", ">", 45.0)]).collect()] == [50.0]


def test_surplus_fields_are_refused_and_missing_ones_null(spark, tmp_path):
    with pytest.raises(Exception, match="more than 2 fields"):
        readers.read_csv(spark, write(tmp_path / "w.csv", 'a,b\n1,"x, y"\n2,z,surplus\n')).collect()
    rows = readers.read_csv(spark, write(tmp_path / "f.csv", 'a,b\n1,"x, ""y"""\n2\n')).collect()
    assert [tuple(r) for r in rows] == [(1, 'x, "y"'), (2, None)]


# -- workbooks --------------------------------------------------------------

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(rows):
    shared, cells = [], []
    for i, row in enumerate(rows, 1):
        line = ""
        for j, v in enumerate(row):
            ref = f"{chr(65 + j)}{i}"
            if isinstance(v, str):
                shared.append(v)
                line += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
            elif isinstance(v, bool):
                line += f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
            elif v is not None:
                line += f'<c r="{ref}"><v>{v}</v></c>'
        cells.append(f'<row r="{i}">{line}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                                      '<sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                                 '<Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return out.getvalue()


def test_a_folder_of_workbooks(spark, tmp_path):
    folder = tmp_path / "books.xlsx"
    os.mkdir(folder)
    (folder / "a.xlsx").write_bytes(workbook([["col_a", "col_b", "col_c"], [1, "x", True], [2, None, False]]))
    (folder / "b.xlsx").write_bytes(workbook([["col_b", "col_a"], ["z", 3.5]]))
    df = readers.read_file(spark, str(folder))
    assert dict(df.dtypes) == {"col_a": "double", "col_b": "string", "col_c": "string"}
    assert {(r["col_a"], r["col_b"]) for r in df.collect()} == {(1.0, "x"), (2.0, None), (3.5, "z")}


def test_date_cells_and_new_columns(spark, tmp_path):
    folder = tmp_path / "dates.xlsx"
    os.mkdir(folder)
    styles = f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'

    def dated(rows):
        out = io.BytesIO(workbook(rows))
        with zipfile.ZipFile(out, "a") as z:
            z.writestr("xl/styles.xml", styles)
        return out.getvalue()

    plain = dated([["day", "n"], [45292, 1]])
    with zipfile.ZipFile(io.BytesIO(plain)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    sheet = parts["xl/worksheets/sheet1.xml"].replace(b'<c r="A2">', b'<c r="A2" s="1">')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, v in (parts | {"xl/worksheets/sheet1.xml": sheet}).items():
            z.writestr(n, v)
    (folder / "a.xlsx").write_bytes(out.getvalue())
    (folder / "b.xlsx").write_bytes(dated([["n", "later"], [2, "x"]]))
    df = readers.read_file(spark, str(folder))
    assert df.columns == ["day", "n", "later"]
    assert {tuple(r) for r in df.collect()} == {("2024-01-01", 1, None), (None, 2, "x")}


def test_null_keys_stay_in_histories(spark):
    log = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 3, 7)], "k string, run long, at long")
    placed = {(r["k"], r["run"]): (r["position"], r["total"]) for r in runlog.history(log, ["k"], "at", ["run"]).collect()}
    assert placed == {(None, 2): (0, 2), (None, 1): (1, 2), ("a", 3): (0, 1)}
    assert score.history(log, ["k"], "at").count() == 3


def test_one_workbook(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["col_a", "col_b"], [1, "x"], [2, "y"], [3, "z"]]))
    df = readers.read_file(spark, str(tmp_path / "a.xlsx"))
    assert readers.shape(df) == (3, 2) and dict(df.dtypes)["col_a"] == "bigint"


# -- sinks ------------------------------------------------------------------


def test_stage_sink_never_overwrites(spark, tmp_path):
    df = spark.range(3)
    a, b = sinks.write_stage(df, str(tmp_path), "cleaned"), sinks.write_stage(df, str(tmp_path), "cleaned")
    assert a != b and spark.read.parquet(a).count() == 3
    sinks.write_stage(df, str(tmp_path), "cleaned", run_id="r1")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_stage(df, str(tmp_path), "cleaned", run_id="r1")
    assert readers.read_file(spark, sinks.write_stage(df, str(tmp_path), "cleaned", fmt="csv")).count() == 3
    with pytest.raises(ValueError):
        sinks.write_stage(df, str(tmp_path), "cleaned", fmt="xls")


def test_sides_are_pruned_partitions(spark, tmp_path):
    df = spark.range(10).withColumn("__split__", F.when(F.col("id") < 2, "test").otherwise("train"))
    read = spark.read.parquet(sinks.write_stage(df, str(tmp_path), "ml_ready"))
    plan = read.filter("__split__ = 'test'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(__split__" in plan and read.filter("__split__ = 'test'").count() == 2


# -- reports and run log ----------------------------------------------------


@pytest.fixture(scope="module")
def reports(spark):
    sizes = spark.createDataFrame([(1, 1200, 5), (2, 10, 3)], "dataset_id int, total_rows long, total_columns long")
    quality = spark.createDataFrame([(1, 60, 400, 40.0, 100, 8.3333)],
                                    "dataset_id int, score int, missing_count long, missing_percentage double, duplicate_rows long, duplicate_percentage double")
    cleaning = spark.createDataFrame([(1, 1200, 800, 400)], "dataset_id int, rows_before long, rows_after long, missing_values_handled long")
    made = spark.createDataFrame([(1, 150, 160, 15)], "dataset_id int, columns_after int, features_added int, features_removed int")
    return report.dataset_report(sizes, quality, cleaning, made)


def test_findings(reports):
    rows = report.dataset_findings(reports).orderBy("dataset_id", "finding_order").collect()
    assert [(r["dataset_id"], r["title"]) for r in rows] == [
        (1, "Dataset Dimensions"), (1, "Overall Data Quality Score"), (1, "Missing Values"), (1, "Duplicate Rows"),
        (1, "Data Cleaning Impact"), (1, "Feature Engineering Summary"), (2, "Dataset Dimensions"),
    ]
    assert rows[0]["value"] == "1200 rows × 5 columns" and rows[0]["description"] == "The dataset contains 1,200 rows and 5 columns."
    assert rows[2]["value"] == "40.0%" and rows[4]["value"] == "400"


def test_recommendations(reports):
    rows = report.dataset_recommendations(reports).orderBy("recommendation_order").collect()
    assert [(r["priority"], r["title"]) for r in rows] == [
        ("high", "Low Data Quality Score"), ("high", "High Missing Value Rate"), ("medium", "Duplicate Rows Detected"),
        ("medium", "High Data Removal Rate"), ("medium", "High Feature Dimensionality"),
    ]


def test_experiment_report(spark):
    experiments = spark.createDataFrame([(1, 7), (2, 7)], "experiment_id int, dataset_id int")
    sizes = spark.createDataFrame([(7, 1000, 4)], "dataset_id int, total_rows long, total_columns long")
    ranked = spark.createDataFrame([(1, 1, "LogisticRegression", 3, "f1", 0.65), (1, 2, "LogisticRegression", 3, "f1", 0.5)],
                                   "experiment_id int, rank int, model_name string, feature_count int, primary_metric string, primary_metric_value double")
    r = report.experiment_report(experiments, ranked, sizes)
    found = report.experiment_findings(r).filter("experiment_id = 1").orderBy("finding_order").collect()
    assert found[2]["description"] == "Best model: LogisticRegression (LogisticRegression) with f1=0.6500"
    titles = {x["title"] for x in report.experiment_recommendations(r).collect()}
    assert titles == {"Poor Model Performance", "Limited Algorithm Diversity"}
    assert report.experiment_findings(r).filter("experiment_id = 2").count() == 2


def test_run_log(spark, tmp_path):
    rows = [(1, 10, "cleaned", 5), (2, 10, "cleaned", 6), (3, 10, "original", 9), (4, 11, "original", 1), (5, 12, "engineered", 2)]
    log = spark.createDataFrame(rows, "run_id int, dataset_id int, stage string, created_at int")
    runlog.append(log, f"{tmp_path}/log", ["stage"])
    runlog.append(log.limit(0), f"{tmp_path}/log", ["stage"])
    log = spark.read.parquet(f"{tmp_path}/log")
    newest = runlog.latest_artifact(log, ["dataset_id", "stage"], "created_at", ["run_id"]).filter("dataset_id = 10 and stage = 'cleaned'")
    assert newest.first()["run_id"] == 2
    source = runlog.stage_source(log, "dataset_id", "stage", "created_at", "run_id", ["engineered", "cleaned", "original"])
    assert {tuple(r) for r in source.collect()} == {(10, "cleaned", 2), (11, "original", 4), (12, "engineered", 5)}
    for limit in (1_000_000, 1):
        placed = {r["run_id"]: (r["position"], r["total"]) for r in runlog.history(log, ["dataset_id"], "created_at", ["run_id"], single_task=limit).collect()}
        assert placed == {3: (0, 3), 2: (1, 3), 1: (2, 3), 4: (0, 1), 5: (0, 1)}


def test_replaced_partitions(spark, tmp_path):
    path = f"{tmp_path}/evaluations"
    runlog.replace_partitions(spark.createDataFrame([("e1", 0.5), ("e2", 0.6)], "experiment string, f1 double"), path, ["experiment"])
    runlog.replace_partitions(spark.createDataFrame([("e1", 0.9)], "experiment string, f1 double"), path, ["experiment"])
    assert {(r["experiment"], r["f1"]) for r in spark.read.parquet(path).collect()} == {("e1", 0.9), ("e2", 0.6)}
