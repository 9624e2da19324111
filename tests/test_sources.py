import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline import cli, session
from plumbline.operators import reports
from plumbline.sources import readers


def text_file(spark, *lines):
    path = session.scratch_path(spark, "lines")
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sort("i").select("value").write.text(path)
    return path


def delimiter(spark, *lines):
    return readers.detect_delimiter(spark, [text_file(spark, *lines)]).head()["delimiter"]


def test_delimiters(spark):
    for mark in (",", "\t", ";", "|"):
        assert delimiter(spark, *[mark.join(r) for r in (("id", "name", "age"), ("1", "A", "3"), ("2", "B", "4"))]) == mark
    assert delimiter(spark, "only", "one") == ","
    assert delimiter(spark, 'a;"x,y"', 'b;"z"') == ";"


def test_ragged_csv(spark):
    scanned = readers.scan_csv(spark, text_file(spark, "id,name", "1,Alice", "2,Bob,Extra", "3,Charlie"))
    assert tuple(readers.malformed_rows(scanned).head()) == (3, 1, 2)
    assert rows(readers.good_rows(scanned)) == [("1", "Alice"), ("3", "Charlie")]


def test_csv_without_header(spark):
    df = readers.good_rows(readers.scan_csv(spark, text_file(spark, "1,Alice", "2,Bob"), ",", header=False))
    assert df.columns == ["_c0", "_c1"] and df.count() == 2


def test_csv_round_trip_with_quotes(spark):
    df = spark.createDataFrame([('a,"b"', None, "x y"), ("plain", "", " p ")], "a string, b string, c string")
    path = session.scratch_path(spark, "quotes")
    reports.write_rows_csv(df, path, ["a", "b", "c"])
    back = readers.good_rows(readers.scan_csv(spark, path, ","))
    assert {r["a"] for r in back.collect()} == {'a,"b"', "plain"}


def test_json_kinds(spark):
    def kind(text, lines=False):
        df = spark.createDataFrame([(text,)], "value string")
        return readers.json_container_kind(df if lines else readers.json_items(df), lines=lines).head()["kind"]

    assert kind('[{"id":1},{"id":2}]') == "array_of_objects"
    assert kind("[1, 2, 3]") == "array_of_primitives"
    assert kind('[{"id":1}, 2]') == "mixed_array"
    assert kind("[[1],[2]]") == "array_of_arrays"
    assert kind("[]") == "unknown"
    assert kind('{"id":1}', lines=True) == "newline_delimited_objects"


def test_json_lines_and_bad_lines(spark):
    path = text_file(spark, '{"id": 1, "name": "A"}', "oops", '{"id": 2, "name": "B"}', '{"id": 3}')
    assert readers.json_format(spark, path) == "lines"
    df = readers.scan_json(spark, path)
    assert df.filter(F.col("id").isNotNull()).count() == 3
    assert tuple(readers.json_bad_lines(spark.read.text(path)).head()) == (4, 1, 3)


def test_primitive_items(spark):
    df = spark.createDataFrame([('"a b"',), ("7",), ("null",), ("true",), ('{"x":1}',), ("[1,2]",)], "value string")
    assert rows(readers.scan_primitive_json(df)) == [("",), ("7",), ("[1,2]",), ("a b",), ("true",)]


def test_a_bad_file_does_not_stop_the_others(spark, sf, capsys):
    out = session.scratch_path(spark, "reports")
    code = cli.run(["/nowhere/x.csv", f"{sf}/region.parquet", "--format", "markdown", "--out", out], spark)
    assert code == 2
    lines = [r[0] for r in spark.read.text(f"{out}/region.parquet_profile.markdown").collect()]
    assert any("r_name" in x for x in lines)


def written(spark, out, name):
    return [r[0] for r in spark.read.text(f"{out}/{name}").collect()]


def csv_folder(folder, **files):
    """A folder of CSV files by name."""
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return folder


def test_the_job_expands_patterns_and_writes_whole_documents(spark, tmp_path):
    folder, out = csv_folder(tmp_path, a=["id,v", "1,x", "2,y"], b=["id,v", "3,", "4,z", "5,z"]), session.scratch_path(spark, "reports")
    assert cli.run([f"{folder}/*.csv", "--out", out, "--merge", "--compare"], spark) == 0
    whole = {n: json.loads("\n".join(written(spark, out, f"{n}.csv_profile.json"))) for n in "ab"}
    assert [(w["meta"]["fileName"], w["summary"]["totalRows"], [c["name"] for c in w["columns"]]) for w in whole.values()] == [
        ("a.csv", 2, ["id", "v"]), ("b.csv", 3, ["id", "v"])]
    assert whole["a"]["meta"]["fileSize"] == 13
    merged = {r["column"]: r for r in map(json.loads, written(spark, out, "merged_profile.json"))}
    assert (merged["id"]["count"], merged["id"]["mean"], merged["v"]["missing"]) == (5, 3.0, 1)
    deltas = {r["column"]: r for r in map(json.loads, written(spark, out, "comparison.json"))}
    assert deltas["id"]["presence"] == "shared" and deltas["id"]["mean_delta"] == 2.5
    trends = [(r["column"], r["metric"]) for r in map(json.loads, written(spark, out, "trends.json"))]
    assert trends == [("id", "distinct"), ("id", "mean"), ("id", "null_rate"), ("v", "distinct"), ("v", "null_rate")]


def test_the_job_does_not_merge_different_schemas_unless_forced(spark, tmp_path, capsys):
    folder = csv_folder(tmp_path, a=["id,v", "1,x"], b=["id", "3"])
    out = session.scratch_path(spark, "reports")
    assert cli.run([f"{folder}/a.csv", f"{folder}/b.csv", "--out", out, "--merge", "--format", "csv"], spark) == 2
    assert "schemas differ" in capsys.readouterr().err and len(written(spark, out, "schema_check.csv")) == 3
    assert cli.run([f"{folder}/a.csv", f"{folder}/b.csv", "--out", out, "--merge", "--force", "--format", "csv"], spark) == 0
    head, *body = written(spark, out, "merged_profile.csv")
    assert head.startswith("column,") and [line.split(",")[0] for line in body] == ["id", "v"]
    assert written(spark, out, "a.csv_profile.csv")[0].startswith("Column,")
    assert cli.run([f"{folder}/none*.csv", "--out", out], spark) == 2
    assert cli.run([f"{folder}/a.csv", "--out", out, "--merge"], spark) == 2


def test_report_names_tell_paths_apart():
    assert cli.report_names(["/x/a.csv", "/y/a.csv", "/y/b.csv", "/y/b.csv"]) == ["x_a.csv", "y_a.csv", "y_b.csv", "y_b.csv_2"]
    assert cli.report_names(["s3://k/t/"]) == ["t"] and cli.report_names([]) == []


def test_gates_set_the_exit_code(spark, sf):
    assert cli.run([f"{sf}/region.parquet", "--quiet", "--fail-on-missing", "5", "--fail-on-duplicates"], spark) == 0
    assert cli.run([f"{sf}/nation.parquet", "--quiet", "--fail-on-duplicates"], spark) == 1


def test_tables(spark, sf):
    readers.register_table(spark, f"{sf}/region.parquet", "some_region")
    assert "some_region" in readers.list_tables(spark)
    assert readers.drop_table(spark, "some_region") and "some_region" not in readers.list_tables(spark)


def test_records_over_several_lines_and_files_of_different_layout(spark):
    one = text_file(spark, "id,note", '1,"first', 'second ""line"""', "2,plain", '3,"a,b"')
    scanned = readers.scan_csv(spark, one)
    assert rows(readers.good_rows(scanned)) == [("1", 'first\nsecond "line"'), ("2", "plain"), ("3", "a,b")]
    assert tuple(readers.malformed_rows(scanned).head()) == (3, 0, 3)
    two = text_file(spark, "id;extra", "7;x", "9;w")
    both = readers.scan_csv(spark, [one, two])
    assert rows(readers.good_rows(both), "id", "note", "extra")[-2:] == [("7", None, "x"), ("9", None, "w")]
    assert readers.malformed_rows(both).head()["malformed"] == 0


def raw_file(spark, tmp_path, text, name="raw.csv"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def splits_restored(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_records_across_lines_are_read_in_splits(spark, tmp_path, splits_restored, seed):
    """The same rows as one task gets that reads the file whole."""
    r = random.Random(seed)
    end = r.choice(["\n", "\r\n"])
    mark = r.choice([",", ";", "|"])

    def cell():
        kind = r.random()
        if kind < 0.5:
            return "".join(r.choice("abc é 5") for _ in range(r.randint(1, 6))) + r.choice(["", "", '" pipe'])
        inner = "".join(r.choice(["x", "yz", '""', end, mark, " ", "line" + end]) for _ in range(r.randint(0, 14 if kind < 0.97 else 400)))
        return f'"{inner}"'

    lines = [mark.join(["one", "two", "three"])] + [mark.join(cell() for _ in range(r.choice([3, 3, 3, 3, 3, 2, 4]))) for _ in range(300)]
    path = raw_file(spark, tmp_path, end.join(lines) + r.choice(["", end]))
    options = {"sep": mark, "header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad_record"}
    whole = spark.read.options(**options, multiLine=True).schema("one string, two string, three string, _bad_record string").csv(path)
    fields = ["one", "two", "three"]
    expected = rows(whole.selectExpr(*fields, "_bad_record is not null"))
    small_splits(spark, 300)
    scanned = readers.scan_csv(spark, path, mark, multiline=True, dataset="place")
    assert rows(scanned.selectExpr(*fields, "_bad_record is not null")) == expected
    found = readers.split_states(readers._lines(spark, [path]), mark)
    assert len(found) == 1 and len(next(iter(found.values()))) > 10
    assert readers._lines(spark, [path]).rdd.getNumPartitions() > 10
    assert {x["place"].split("/")[-1] for x in scanned.select("place").distinct().collect()} == {"raw.csv"}


def test_a_cell_longer_than_several_splits(spark, tmp_path, splits_restored):
    big = "line of text\n" * 200
    path = raw_file(spark, tmp_path, f'a,b\n1,"{big}"\n2,x\n3,"open at the end\nof the file')
    small_splits(spark, 256)
    got = {x["a"]: x["b"] for x in readers.scan_csv(spark, path).collect()}
    assert got["1"] == big and got["2"] == "x" and set(got) == {"1", "2", "3"}


@pytest.mark.parametrize("line, out, in_", [
    ("a,b", False, True), ('"a","b', True, True), ('x","y', True, True), ('x",y', False, False), ('5" pipe,b', False, True),
    ('"a ""x"" b', True, True), ('"",""', False, True), ('"""', True, False), ('', False, True), ('"a"\r', False, True), ('"', True, False), (',"', True, False)])
def test_quote_states(line, out, in_):
    state = readers.QuoteState(",")
    assert (state.after(line, False), state.after(line, True)) == (out, in_)
