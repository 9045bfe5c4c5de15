"""Schemas that drift between files: one consistent table and a report of every change.

Files are read as path-value maps with raw types (``record_fields``, ``path_values``). Path and type
statistics are aggregated by file (``path_kinds``, ``path_statistics``); consecutive files of a stream are
then compared field by field (``schema_changes``), and typed columns are projected with a report of the casts
that failed (``consistent_table``).
"""

from __future__ import annotations

import json
from collections.abc import Container, Iterator, Sequence
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsontext import canonical, loads
from ..session import write_out

PATH_VALUES = "file_id bigint, path string, parent string, record string, kind string, value string"
CHANGES = "file_id bigint, change string, old_name string, new_name string"

_KINDS = {dict: "object", list: "list", str: "string", bool: "boolean", int: "number", float: "number"}


def record_fields(content: dict, record_key: str, wanted: Container[str] | None = None) -> Iterator[tuple]:
    """(path, parent, record, values) of each field of each record of one file, of the paths ``wanted`` or all.

    A record is the file itself (record ``''``) or the outermost list member that has
    ``record_key``. A field is a path of keys joined by dots, with ``[]`` after a list. A field that
    stands several times in one record (below an inner list) yields all its values in order.
    """
    found: dict[tuple[str, str], list] = {}
    parents: dict[str, str] = {}
    seen: dict[str, int] = {}
    # prefix of the fields below, record, value
    stack: list[tuple[str, str | None, object]] = [("", None, content)]
    while stack:
        prefix, record, value = stack.pop()
        if isinstance(value, dict):
            rec = record or ""
            for key in reversed(value):
                if isinstance(value[key], (dict, list)):
                    stack.append((f"{prefix}.{key}" if prefix else key, record, value[key]))
            for key, v in value.items():
                path = f"{prefix}.{key}" if prefix else key
                if wanted is None or path in wanted:
                    parents[path] = prefix
                    found.setdefault((path, rec), []).append(v)
        elif isinstance(value, list):
            for v in reversed(value):
                inner = record
                if record is None and isinstance(v, dict):
                    name = v.get(record_key)
                    name = canonical(name) if name is not None else "?"
                    # of several records with one name the n-th meets the n-th; records without a name meet none
                    n = seen[name] = seen.get(name, -1) + 1
                    inner = f"{name}#{n}" if n or name == "?" else name
                if isinstance(v, (dict, list)):
                    stack.append((f"{prefix}[]", inner, v))
    for (path, rec), values in found.items():
        yield path, parents[path], rec, values


def path_kinds(content: dict) -> dict[str, tuple[str, frozenset[str]]]:
    """Path to (parent, JSON types of its non-null values) of all fields of a file."""
    found: dict[str, tuple[str, set]] = {}
    stack: list[tuple[str, object]] = [("", content)]
    while stack:
        prefix, value = stack.pop()
        if type(value) is list:
            prefix += "[]"
            stack.extend((prefix, v) for v in value if type(v) is dict or type(v) is list)
            continue
        for key, v in value.items():
            path = f"{prefix}.{key}" if prefix else key
            got = found.get(path)
            if got is None:
                got = found[path] = (prefix, set())
            if v is not None:
                got[1].add(type(v))
                if type(v) is dict or type(v) is list:
                    stack.append((path, v))
    return {path: (parent, frozenset(_KINDS[t] for t in kinds)) for path, (parent, kinds) in found.items()}


def path_values(df: DataFrame, file_id: str = "file_id", content: str = "content", record_key: str = "relative_path", texts: bool = False, nested: bool = True) -> DataFrame:
    """Rows (file_id, path, parent, record, kind, value), one per field, record and type.

    ``kind`` is the raw JSON type, NULL where the key stands with a null only; ``value`` is set for scalars, with
    ``texts`` also for objects and lists, as JSON, but not for a file's lists of records. Without ``nested``
    only fields of a file and of its outermost records come out, not those below them.
    Null, damaged or non-object contents give no rows; other columns are ignored. Narrow; any depth.
    """
    names = ["file_id", "path", "parent", "record", "kind", "value"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for fid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = read_object(text)
                if got is None:
                    continue
                fields = list(record_fields(got, record_key))
                holders = {parent[:-2] for _, parent, record, _ in fields if record and parent.endswith("[]")}
                for path, parent, record, values in fields:
                    if not nested and not ((record == "") == (parent == "") and (parent == "" or (parent.endswith("[]") and "." not in parent))):
                        continue
                    kept = [v for v in values if v is not None]
                    if not kept:
                        rows.append((fid, path, parent, record, None, None))
                        continue
                    for kind in {_KINDS[type(v)] for v in kept}:
                        one = kept[0] if len(kept) == 1 and kind not in ("object", "list") else None
                        value = None if one is None else one if kind == "string" else json.dumps(one)
                        if texts and len(values) == 1 and kind in ("object", "list") and (record or path not in holders):
                            value = canonical(kept[0])
                        rows.append((fid, path, parent, record, kind, value))
                if len(rows) >= 20_000:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)

    return df.select(F.col(file_id).cast("long").alias("i"), F.col(content).cast("string").alias("c")).mapInArrow(parse, PATH_VALUES)


def read_object(text: str | None) -> dict | None:
    """The JSON object that a file holds, of any depth, or None where it is null or can't be read as one."""
    if not text:
        return None
    try:
        got = loads(text)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def readable_files(files: DataFrame, file_id: str = "file_id", content: str = "content") -> DataFrame:
    """(file_id) of the files that hold a JSON object. Narrow."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [read_object(t) is not None for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_()))], ["file_id"])

    return files.select(F.col(file_id).cast("long").alias("i"), F.col(content).cast("string").alias("c")).mapInArrow(read, "file_id bigint")


def path_statistics(values: DataFrame) -> DataFrame:
    """Per file and path: ``kinds`` (sorted types of non-null values), records and non-null records."""
    return values.groupBy("file_id", "path", "parent").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.count_distinct("record").alias("records"), F.count_distinct(F.when(F.col("kind").isNotNull(), F.col("record"))).alias("filled")
    )


def previous_file(files: DataFrame, stream: str = "stream_id", written: str = "written_at", file_id: str = "file_id", slice_days: int = 30) -> DataFrame:
    """(file_id, prev_id): the file before each in its stream, by time and then id.

    ``lag`` runs within a stream's month; the first file of a month takes the last of the months
    before from a summary, so a stream that holds most files isn't sorted in one task.
    Null streams count as one stream; a null time sorts first.
    """
    f = files.select(F.col(stream).alias("st"), F.unix_micros(F.col(written).cast("timestamp")).alias("at"), F.col(file_id).cast("long").alias("id"))
    f = f.withColumn("month", F.coalesce(F.floor(F.col("at") / F.lit(slice_days * 86_400_000_000)).cast("long"), F.lit(-(1 << 40)).cast("long")))
    key = F.struct(F.coalesce("at", F.lit(-(1 << 62)).cast("long")), "id")
    tails = f.groupBy("st", "month").agg(F.max_by("id", key).alias("tail"))
    w = Window.partitionBy("st").orderBy("month")
    tails = tails.select(F.col("st").alias("_st"), F.col("month").alias("_m"), F.lag("tail").over(w).alias("before"))
    f = f.withColumn("p", F.lag("id").over(Window.partitionBy("st", "month").orderBy("at", "id")))
    f = f.join(tails, f["st"].eqNullSafe(F.col("_st")) & (f["month"] == F.col("_m")), "left")
    return f.select(F.col("id").alias("file_id"), F.coalesce("p", "before").alias("prev_id")).where("prev_id is not null")


def content_changes(old: dict, new: dict, record_key: str = "relative_path") -> list[tuple[str, str, str]]:
    """(change, old_name, new_name) between two files, from their path and type statistics.

    ``added``, ``removed``, ``renamed`` (same parent; equal values in every record of both files that
    has both, at least one; the pairing is one to one, best filled and then first by name) and
    ``type_changed``. Fields below a reported field aren't reported.
    """
    was, now = path_kinds(old), path_kinds(new)
    raw = [("removed", p, was[p][0]) for p in was.keys() - now.keys()] + [("added", p, now[p][0]) for p in now.keys() - was.keys()]
    raw += [("type_changed", p, now[p][0]) for p in was.keys() & now.keys() if was[p][1] != now[p][1] and was[p][1] and now[p][1]]
    said = {p for _, p, _ in raw}
    raw = [(c, p, parent) for c, p, parent in raw if not any(p[:i] in said for i, ch in enumerate(p) if ch in ".[")]
    gone: dict[str, list[str]] = {}
    came: dict[str, list[str]] = {}
    for change, path, parent in raw:
        if change != "type_changed":
            (gone if change == "removed" else came).setdefault(parent, []).append(path)
    shared = gone.keys() & came.keys()
    renamed: list[tuple[int, str, str]] = []
    if shared:
        before, after = ({}, {})
        for content, names, into in ((old, gone, before), (new, came, after)):
            for path, parent, record, values in record_fields(content, record_key, {p for s in shared for p in names[s]}):
                if not record.startswith("?") and any(v is not None for v in values):
                    into.setdefault(parent, {}).setdefault(path, {})[record] = blake2b(canonical(values).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for parent in shared:
            # names meet where they agree in a record; only those are compared in all
            holders: dict[tuple, list[str]] = {}
            for path, values in after.get(parent, {}).items():
                for item in values.items():
                    holders.setdefault(item, []).append(path)
            for a, x in before.get(parent, {}).items():
                for b in {b for item in x.items() for b in holders.get(item, ())}:
                    y = after[parent][b]
                    both = x.keys() & y.keys()
                    if all(x[r] == y[r] for r in both):
                        renamed.append((len(both), a, b))
    # one to one: a pair stands if it is the best of both its names
    best_old, best_new = {}, {}
    for n, a, b in renamed:
        best_old[a] = min(best_old.get(a, (0, "")), (-n, b))
        best_new[b] = min(best_new.get(b, (0, "")), (-n, a))
    renamed = [(a, b) for n, a, b in renamed if best_old[a] == (-n, b) and best_new[b] == (-n, a)]
    used = {("removed", a) for a, _ in renamed} | {("added", b) for _, b in renamed}
    rest = [(c, "" if c == "added" else p, "" if c == "removed" else p) for c, p, _ in raw if (c, p) not in used]
    return rest + [("renamed", a, b) for a, b in renamed]


def schema_changes(files: DataFrame, stream: str = "stream_id", written: str = "written_at", file_id: str = "file_id", content: str = "content") -> DataFrame:
    """Changes of each file against the readable file before it in its stream: (file_id, change, old_name, new_name).

    Order is by time and then id. Two files that follow each other meet in one row, so contents are shuffled twice
    and no value of them alone. See ``content_changes``; files with no field, repeated files and empty tables give no rows.
    """
    ids = readable_files(files, file_id, content)
    meta = files.select(stream, written, F.col(file_id).cast("long").alias("file_id")).join(ids, "file_id", "left_semi").distinct()
    pairs = write_out(previous_file(meta, stream, written, "file_id"), "drift-pairs")
    text = files.select(F.col(file_id).cast("long").alias("i"), F.col(content).cast("string").alias("c")).dropDuplicates(["i"])
    both = pairs.join(text.select(F.col("i").alias("file_id"), F.col("c").alias("new")), "file_id")
    both = both.join(text.select(F.col("i").alias("prev_id"), F.col("c").alias("old")), "prev_id").select("file_id", "old", "new")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fid, old, new in zip(*(batch.column(i).to_pylist() for i in range(3))):
                a, b = read_object(old), read_object(new)
                if a is not None and b is not None:
                    rows.extend((fid, *c) for c in content_changes(a, b))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string()))], ["file_id", "change", "old_name", "new_name"])

    return both.mapInArrow(compare, CHANGES)


def with_aliases(columns: Sequence[tuple[str, Sequence[str], str]], renamed: Sequence[tuple[str, str, int]]) -> list[tuple[str, list[str], str]]:
    """``columns`` with the names that renames lead to: (old name, new name, times seen), in either direction.

    A name goes to the column that it is tied to most often (of equals the first by name), chains are
    followed; the names stated for a column stay with it.
    """
    home = {p: name for name, paths, _ in columns for p in paths}
    out = {name: list(paths) for name, paths, _ in columns}
    while True:
        votes: dict[str, dict[str, int]] = {}
        for a, b, n in renamed:
            for x, y in ((a, b), (b, a)):
                if x in home and y not in home:
                    per = votes.setdefault(y, {})
                    per[home[x]] = per.get(home[x], 0) + n
        if not votes:
            return [(name, out[name], kind) for name, _, kind in columns]
        for path, per in sorted(votes.items()):
            home[path] = min(per, key=lambda c: (-per[c], c))
            out[home[path]].append(path)


def consistent_table(values: DataFrame, columns: Sequence[tuple[str, Sequence[str], str]], others: str | None = None) -> DataFrame:
    """One typed row per file and record: ``columns`` = (name, alias paths in order, type).

    A type is Spark's, or ``object`` or ``list`` for such values as JSON text. The first alias that
    has a value counts. ``failed_casts`` lists ``name:path`` for each value that doesn't cast to its
    column's type: objects and lists never cast to Spark's types, scalars never to the other two.
    Records with none of the paths keep a row of nulls. ``others`` names a column that maps every
    path without a column to its value as text.
    """
    # cells of a record are keyed by column, those without one by "$" and their path
    place = {p: (name, j) for name, paths, _ in columns for j, p in enumerate(paths)}
    at = values.sparkSession.createDataFrame([(p, *x) for p, x in place.items()], "path string, name string, rank int")
    cell = F.when(F.col("kind").isNotNull(), F.struct(F.coalesce("name", F.concat(F.lit("$"), "path")).alias("key"), F.coalesce("rank", F.lit(0)).alias("rank"), "path", "kind", "value"))
    cells = values.join(F.broadcast(at), "path", "left").groupBy("file_id", "record").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    first = F.filter("cells", lambda c, i: (i == 0) | (F.get(F.col("cells"), i - 1)["key"] != c["key"]))
    wide = cells.select("file_id", "record", F.map_from_entries(F.transform(first, lambda c: F.struct(c["key"], c))).alias("m"))
    out, failed = [], []
    for name, _, kind in columns:
        c = F.col("m")[name]
        nested = c["kind"].isin("object", "list")
        cast = F.when(c["kind"] == kind, c["value"]) if kind in ("object", "list") else F.when(~nested, c["value"].try_cast(kind))
        out.append(cast.alias(name))
        there = c["value"].isNotNull() | nested
        failed.append(F.when(there & cast.isNull(), F.concat(F.lit(f"{name}:"), c["path"])))
    if others:
        rest = F.map_filter("m", lambda k, c: F.startswith(k, F.lit("$")) & c["value"].isNotNull())
        out.append(F.transform_keys(F.transform_values(rest, lambda k, c: c["value"]), lambda k, v: F.substring(k, 2, 1 << 30)).alias(others))
    return wide.select("file_id", "record", *out, F.array_compact(F.array(*failed)).alias("failed_casts"))
