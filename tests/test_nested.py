import json

from cuelattice.operators import nested
from cuelattice.queries.problems import LIST_KEYS


def found(spark, payloads):
    df = spark.createDataFrame([(i, p, "x", "y") for i, p in enumerate(payloads)], "artifact_id long, payload string, path string, ordinal string")
    return {tuple(r) for r in nested.group_rows(df, list_keys=LIST_KEYS).select("artifact_id", "row_path", "parent_path").collect()}


def test_members_and_parents(spark):
    p = json.dumps({"videos": [{"slots": {"a": 1}}, None, {"pace_over_time": '[{"x": 1}, 3, {"y": [[{"z": 1}]]}]'}], "other": {"b": 1}, "tags": ["t"]})
    assert found(spark, [p]) == {
        (0, "$.videos[0]", "$"),
        (0, "$.videos[0].slots[0]", "$.videos[0]"),
        (0, "$.videos[2]", "$"),
        (0, "$.videos[2].pace_over_time[0]", "$.videos[2]"),
        (0, "$.videos[2].pace_over_time[2]", "$.videos[2]"),
        (0, "$.videos[2].pace_over_time[2].y[0][0]", "$.videos[2].pace_over_time[2]"),
    }


def test_damaged_and_odd(spark):
    assert found(spark, [None, "", "{", "[1", '"x"', "3", "null", '{"slots": "not json"}', '{"slots": "{broken"}', '{"slots": []}']) == set()
    assert found(spark, ['[{"a": 1}, [{"b": 2}]]', '{"videos": "{\\"q\\": 1}"}']) == {(0, "$[0]", "$"), (0, "$[1][0]", "$"), (1, "$.videos[0]", "$")}
    assert found(spark, []) == set()


def test_long_and_deep(spark):
    deep = '{"a":[' * 300 + "1" + "]}" * 300
    assert found(spark, ['{"a":' + "[" * 5000 + '{"b":1}' + "]" * 5000 + "}", "[" * 20_000]) == {(0, "$.a" + "[0]" * 5000, "$")}
    got = found(spark, [deep, json.dumps({"slots": [{"i": i} for i in range(30_000)]})])
    assert len([g for g in got if g[0] == 0]) == 299 and len([g for g in got if g[0] == 1]) == 30_000


def test_flat_table_keeps_links(spark):
    p = json.dumps({"slots": [{"index": 0, "anchor": {"time": 1.5}, "words": ["a", "b"]}, {"index": 1}, {}]})
    df = spark.createDataFrame([(7, p)], "artifact_id long, payload string")
    t = nested.group_rows(df, list_keys=LIST_KEYS)
    rows = {r["row_path"]: r for r in nested.flat_table(t, "$.slots[]", ["index", "anchor.time", "words[]", "words"]).collect()}
    assert set(rows) == {"$.slots[0]", "$.slots[1]", "$.slots[2]"}
    assert rows["$.slots[0]"]["anchor_time"] == "1.5" and rows["$.slots[0]"]["words"] == '["a","b"]'
    assert rows["$.slots[1]"]["index"] == "1" and rows["$.slots[2]"]["index"] is None and rows["$.slots[2]"]["ordinal"] == 2


def test_groups_in_any_envelope(spark):
    slot = {"index": 1, "alternatives": [{"score": 2}]}
    ps = [{"slots": [slot]}, {"timeline": {"slots": [slot, 5]}}, {"result": {"timeline": {"slots": slot}}}, {"no_slots": [slot]}, {"videos": [{"e": {"pace_over_time": [{"phase": "a", "tags": ["x", "y"]}, {}]}}]}]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(ps)], "artifact_id long, payload string")
    t = nested.group_rows(df, list_keys=LIST_KEYS)
    got = {(r["artifact_id"], r["row_path"], r["index"]) for r in nested.key_table(t, "slots", ["index"]).collect()}
    assert got == {(0, "$.slots[0]", "1"), (1, "$.timeline.slots[0]", "1"), (2, "$.result.timeline.slots[0]", "1")}
    rows = t.collect()
    members = nested.path_triples(df, list_keys=LIST_KEYS).where("kind = 'object' and ordinal is not null")
    assert sorted((r["artifact_id"], r["row_path"], r["parent_path"]) for r in rows) == sorted(map(tuple, members.select("artifact_id", "path", "parent_path").collect()))
    pace = {r["row_path"]: r for r in rows if r["group_path"] == "$.videos[].e.pace_over_time[]"}
    first = pace["$.videos[0].e.pace_over_time[0]"]
    assert first["fields"] == {"phase": "a"} and first["lists"] == {"tags": ["x", "y"]} and pace["$.videos[0].e.pace_over_time[1]"]["fields"] == {}
    assert {r["phase"] for r in nested.key_table(t, "pace_over_time", ["phase"]).collect()} == {"a", None}


def test_objects_with_one_path_keep_their_own_values(spark):
    df = spark.createDataFrame([(1, json.dumps({"a.b": [{"x": 1}], "a": {"b": [{"x": 2}]}}))], "artifact_id long, payload string")
    rows = nested.group_rows(df).collect()
    assert [r["row_path"] for r in rows] == ["$.a.b[0]"] * 2 and [r["fields"]["x"] for r in rows] == ["1", "2"]
