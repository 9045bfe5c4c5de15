import collections
import json

from cuelattice.operators import drift
from cuelattice.queries.problems import p5_found, p5_table

KINDS = {dict: "object", list: "list", str: "string", bool: "boolean", int: "number", float: "number"}


def fields(content):
    ex, kinds, vals = set(), collections.defaultdict(set), collections.defaultdict(lambda: collections.defaultdict(list))

    def go(v, pre, rec):
        if isinstance(v, dict):
            for k, x in v.items():
                p = f"{pre}.{k}" if pre else k
                ex.add(p)
                vals[p][rec].append(x)
                if x is not None:
                    kinds[p].add(KINDS[type(x)])
                go(x, p, rec)
        elif isinstance(v, list):
            for x in v:
                go(x, pre + "[]", ("r", x.get("relative_path")) if rec == "" and isinstance(x, dict) else rec)

    go(content, "", "")
    return ex, kinds, vals


def changes(a, b):
    (ea, ka, va), (eb, kb, vb) = a, b
    rem, add = ea - eb, eb - ea
    typed = {p for p in ea & eb if ka[p] and kb[p] and ka[p] != kb[p]}
    said = rem | add | typed
    rem, add, typed = ({p for p in x if not any(p != q and (p.startswith(q + ".") or p.startswith(q + "[")) for q in said)} for x in (rem, add, typed))
    pairs = []
    for r in rem:
        for x in add:
            if r.rpartition(".")[0] != x.rpartition(".")[0]:
                continue
            met = [(va[r][c], vb[x][c]) for c in va[r] if c != ("r", None) and c in vb[x] and any(v is not None for v in va[r][c]) and any(v is not None for v in vb[x][c])]
            if met and all(p == q for p, q in met):
                pairs.append((-len(met), r, x))
    out, olds, news = [], set(), set()
    for _, r, x in sorted(pairs):
        if r not in olds and x not in news:
            olds.add(r)
            news.add(x)
            out.append(("renamed", r, x))
    return out + [("removed", p, "") for p in rem - olds] + [("added", "", p) for p in add - news] + [("type_changed", p, p) for p in typed]


def brute(rows):
    by = collections.defaultdict(list)
    for fid, stream, at, text in rows:
        got = drift.read_object(text)
        if got is not None:
            by[stream].append((at, fid, fields(got)))
    return {(q[1], *c) for files in by.values() for fs in [sorted(files, key=lambda f: f[:2])] for p, q in zip(fs, fs[1:]) for c in changes(p[2], q[2])}


def run(spark, rows):
    df = spark.createDataFrame(rows, "file_id long, stream_id string, written_at timestamp, content string")
    got = [tuple(r) for r in drift.schema_changes(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_changes(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, 1) + dt.timedelta(days=40 * i) for i in range(6)]
    e = lambda **k: {"relative_path": "a", **k}
    docs = [
        {"v": "1", "entries": [e(x=1, y="q", z={"u": 1}), {"relative_path": "b", "x": None, "y": "r"}], "gone": {"in": {"deep": 1}}},
        {"w": "1", "entries": [e(x="1", yy="q"), {"relative_path": "b", "yy": "r", "x": None}], "new": [1]},
        None,
        {"w": 1, "entries": {"x": 1}},
        {"w": 1.0, "entries": []},
        {"w": True, "entries": [{"tags": ["a"], "n": [[{"k": 1}]]}]},
    ]
    rows = [(i, "s", t[i], json.dumps(d) if d else "{damaged") for i, d in enumerate(docs)]
    rows += [(10 + i, None, t[i], json.dumps(docs[0])) for i in range(2)] + [(20, "z", t[0], None), (21, "z", t[1], "[]")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (1, "renamed", "v", "w") in got and (1, "renamed", "entries[].y", "entries[].yy") in got and (1, "removed", "gone", "") in got
    assert (1, "type_changed", "entries[].x", "entries[].x") in got and not any("deep" in r[2] for r in got)


def test_empty(spark):
    assert run(spark, []) == set()


def test_repeated_files_and_deep_contents(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, 1 + i) for i in range(3)]
    deep = lambda key: '{"x": ' + "[" * 20_000 + "]" * 20_000 + f', "{key}": ' + '{"u":' * 500 + "1" + "}" * 500 + "}"
    rows = [(1, "s", t[0], deep("a")), (2, "s", t[1], deep("b")), (2, "s", t[1], deep("b")), (3, "s", t[2], None)]
    assert run(spark, rows) == {(2, "renamed", "a", "b")}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/index_file.parquet").select("file_id", "stream_id", "written_at", "content").collect()]
    got = p5_found(spark, sf).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows)


def test_consistent_table_reports_failed_casts(spark):
    text = json.dumps({"entries": [{"relative_path": "a", "n": "12"}, {"relative_path": "b", "m": "x"}, {"relative_path": "c"}]})
    df = spark.createDataFrame([(1, text)], "file_id long, content string")
    v = drift.path_values(df).where("startswith(path, 'entries[]')")
    rows = {r["name"]: r for r in drift.consistent_table(v, [("name", ["entries[].relative_path"], "string"), ("n", ["entries[].n", "entries[].m"], "bigint")]).collect()}
    assert rows["a"]["n"] == 12 and rows["b"]["n"] is None and rows["b"]["failed_casts"] == ["n:entries[].m"] and rows["c"]["failed_casts"] == []
    s = {r["path"]: r for r in drift.path_statistics(drift.path_values(df)).collect()}
    assert s["entries[].n"]["kinds"] == ["string"] and s["entries[].n"]["records"] == 1


def test_table_follows_renames_and_keeps_all_parts(spark, tmp_path):
    import datetime as dt

    e = {"relative_path": "a", "size_bytes": 5, "motion_score": [0.5], "scene_category": {"value": "x"}, "new_field": [1, "q"]}
    docs = [
        {"schema_version": "1.0", "entries": [e]},
        {"version": "1.0", "entries": [{"relative_path": "a", "file_size": 5, "quality": {"value": 1.5}, "motion_score": "bad"}]},
        {"schema_version": 2, "videos": [{"relative_path": "v", "transition_method": "cut"}, {"relative_path": "w"}]},
        {"schema_version": "2", "videos": [{"relative_path": "v", "method": "cut", "key_shot_positions": [{"start": 1}]}]},
    ]
    rows = [(i, "s" if i < 2 else "t", dt.datetime(2024, 1, 1 + i), json.dumps(d)) for i, d in enumerate(docs)] + [(9, "t", dt.datetime(2024, 1, 9), "{damaged")]
    spark.createDataFrame(rows, "file_id long, stream_id string, written_at timestamp, content string").write.parquet(f"{tmp_path}/index_file.parquet")
    got = {(r["file_id"], r["relative_path"]): r for r in p5_table(spark, str(tmp_path)).collect()}
    assert set(got) == {(0, None), (0, "a"), (1, None), (1, "a"), (2, None), (2, "v"), (2, "w"), (3, None), (3, "v")}
    assert [got[i, None]["schema_version"] for i in range(4)] == ["1.0", "1.0", "2", "2"]
    assert got[0, "a"]["size_bytes"] == got[1, "a"]["size_bytes"] == 5 and got[1, "a"]["quality"] == '{"value":1.5}'
    assert sorted(got[0, "a"]["failed_casts"]) == ["motion_score:entries[].motion_score", "scene_category:entries[].scene_category"]
    assert got[1, "a"]["failed_casts"] == ["motion_score:entries[].motion_score"]
    assert got[0, "a"]["other_fields"] == {"entries[].new_field": '[1,"q"]'}
    assert got[2, "v"]["transition_method"] == got[3, "v"]["transition_method"] == "cut" and json.loads(got[3, "v"]["key_shot_positions"]) == [{"start": 1}]
