from pyspark.sql import functions as F

from conftest import rows
from plumbline.operators import flatten, structure


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, doc string")
    return structure.structure_scan(df, "doc", "k")


def by_path(paths):
    return {r["path"]: r for r in paths.collect()}


def test_six_levels_advise_a_tree(spark):
    paths = scan(spark, '{"level1":{"level2":{"level3":{"level4":{"level5":{"value":1}}}}}}')
    s = structure.structure_summary(paths).head()
    assert (s["max_depth"], s["total_paths"], s["mode"]) == (6, 7, "tree")


def test_wide_record(spark):
    s = structure.structure_summary(scan(spark, "{" + ",".join(f'"f{i}":{i}' for i in range(100)) + "}")).head()
    assert (s["total_paths"], s["max_depth"], s["mode"]) == (101, 1, "tabular")


def test_optional_and_mixed(spark):
    p = by_path(scan(spark, '{"id":1,"email":"a","v":"x"}', '{"id":2,"v":1}', '{"id":3,"email":"b","v":true}', '{"id":4,"v":null}'))
    assert p["$.email"]["population"] == 50.0 and p["$.v"]["data_type"] == "mixed" and p["$"]["child_count"] == 3
    assert p["$.id"]["examples"] == ["1", "2", "3"] and p["$.email"]["parent_path"] == "$"


def test_bad_lines_are_left_out_and_arrays_not_entered(spark):
    p = by_path(scan(spark, '{"a":[{"b":1}]}', "nope"))
    assert set(p) == {"$", "$.a"} and p["$.a"]["data_type"] == "array" and p["$"]["occurrences"] == 1


def test_tree_views(spark):
    paths = scan(spark, '{"a":{"b":1,"c":2},"d":3}')
    assert rows(structure.leaf_paths(paths), "path") == [("$.a.b",), ("$.a.c",), ("$.d",)]
    t = structure.tree_stats(paths).head()
    assert (t["total_nodes"], t["leaf_nodes"], t["max_depth"], t["avg_population"]) == (5, 3, 2, 100.0)


def test_flatten_record(spark):
    df = spark.sql("select 1 as a, named_struct('c', 2, 'd', 'x') as b, array(1, 2) as e, cast(null as string) as z")
    assert flatten.flatten_struct(df).columns == ["a", "b.c", "b.d", "e", "z"]
    assert tuple(flatten.flatten_struct(df).head()) == ("1", "2", "x", "[1,2]", "")
    assert tuple(flatten.flatten_json(df).head()) == ("1", "2", "x", "[array:2]", "")


def test_flatten_stops_at_depth_and_keeps_every_column(spark):
    df = spark.sql("select named_struct('b', named_struct('c', named_struct('d', named_struct('e', 1)))) as a, 2 as z")
    assert flatten.flatten_json(df).columns == ["a.b.c.d", "z"]
    assert flatten.flatten_json(df).head()[0] == '{"e":1}'
    wide = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(600)])
    assert len(flatten.flatten_json(wide).columns) == 600 and len(flatten.select_paths(wide, [f"$.c{i}" for i in range(600)]).columns) == 600


def test_array_stats(spark):
    df = spark.createDataFrame([([1, 2],), ([],), (None,), ([3],)], "e array<int>")
    r = flatten.array_stats(df).head()
    assert tuple(r) == ("e", 0, 2, 3, 3, 1.0)


def test_recommended_view(spark):
    df = spark.sql("select named_struct('b', named_struct('c', named_struct('d', 1))) as a")
    assert flatten.recommended_view(flatten.schema_tree(df)).head()["mode"] == "tree"
    assert flatten.recommended_view(flatten.schema_tree(spark.range(1))).head()["mode"] == "tabular"


def test_deep_and_dotted_keys(spark):
    deep = "1"
    for _ in range(40):
        deep = '{"k": ' + deep + "}"
    df = spark.createDataFrame([(1, deep), (2, '{"a.b": 1, "a": {"b": 2}}')], "id long, j string")
    paths = structure.structure_scan(df, "j", "id")
    assert structure.structure_summary(paths).head()["max_depth"] == 40
    assert sorted((r["depth"], r["parent_path"], r["examples"]) for r in paths.filter("path = '$.a.b'").collect()) == [(1, "$", ["1"]), (2, "$.a", ["2"])]


def test_passes_of_few_levels_see_every_level_once(spark, monkeypatch):
    texts = ['{"a":{"b":{"c":{"d":1,"e":{"f":[1]}},"c2":null},"x":"1"}}', '{"a":{"b":{"c":7}}}', '{"a":"flat"}', "[1]", "{", "3"]
    whole = rows(scan(spark, *texts))
    for levels in (1, 2, 3):
        monkeypatch.setattr(structure, "LEVELS", levels)
        assert rows(scan(spark, *texts)) == whole
    assert {r[0]: r[4] for r in whole}["$"] == 5 and {r[0]: r[3] for r in whole}["$.a.b.c"] == "mixed"
    assert scan(spark, "nope").count() == 0
