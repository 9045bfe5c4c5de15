"""Deeply nested records into related flat tables.

``walk`` takes a record apart into path–value–ordinal triples, ``path_triples`` gives those of a table.
A row's group is its repeated ancestor (the path with positions blanked); ``group_rows`` pivots all groups
into rows that know their record, their own path and their parent's path;
``flat_table`` gives one group the columns that are stated, ``key_table`` all groups of a repeated key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import loads

TRIPLES = "artifact_id bigint, path string, parent_path string, group_path string, field string, ordinal bigint, kind string, value string"

_KINDS = {dict: "object", list: "list", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def _held(text: str):
    """What a string holds, if that is a JSON list or object, else the string."""
    head = text.lstrip()[:1]
    if head not in ("{", "["):
        return text
    try:
        got = loads(text)
    except ValueError:
        return text
    return got if isinstance(got, (list, dict)) else text


def walk(record, list_keys: frozenset[str], only: frozenset[str] | None = None) -> Iterator[tuple]:
    """(path, parent_path, group_path, field, ordinal, kind, value) of every value below the root.

    Iterative, so that depth is bounded by memory alone. ``ordinal`` is set on list members.
    ``group_path`` is the row's nearest enclosing repeated object with positions blanked.
    Under ``list_keys`` a lone object is a list of one and text that holds a list or object is
    taken as what it holds. ``only`` keeps rows of these kinds.
    """
    # path, parent (closest enclosing list member that is an object), its blanked form, field, ordinal, value
    stack = [("$", "$", "$", "", None, record)]
    while stack:
        path, parent, group, field, ordinal, value = stack.pop()
        kind = _KINDS[type(value)]
        if path != "$" and (only is None or kind in only):
            text = None if kind in ("object", "list", "null") else value if kind == "string" else json.dumps(value)
            yield path, parent, group, field, ordinal, kind, text
        if kind == "object":
            if ordinal is not None:
                parent, group, field = path, (f"{group}.{field}[]" if field else f"{group}[]"), ""
            for key in reversed(value):
                child = value[key]
                if key in list_keys:
                    if isinstance(child, str):
                        child = _held(child)
                    if isinstance(child, dict):
                        child = [child]
                stack.append((f"{path}.{key}", parent, group, f"{field}.{key}" if field else key, None, child))
        elif kind == "list":
            deeper = f"{field}[]" if ordinal is not None else field
            for i in range(len(value) - 1, -1, -1):
                stack.append((f"{path}[{i}]", parent, group, deeper, i, value[i]))


def path_triples(
    df: DataFrame, id_col: str = "artifact_id", payload: str = "payload", list_keys: Sequence[str] = (), kinds: Sequence[str] | None = None
) -> DataFrame:
    """Path–value–ordinal rows of every record's payload.

    One row per value: ``artifact_id``, ``path``, ``parent_path`` (closest enclosing list member
    that is an object, else ``$``), ``group_path`` (that parent with positions blanked), ``field``
    (keys from the parent), ``ordinal`` (set on list members), ``kind`` and ``value`` (scalars).
    Null, empty and damaged payloads give no rows; of a key that is repeated in one object the last counts; other columns are ignored; null
    ids pass through. ``kinds`` prunes rows at the parser. Narrow: no shuffle, any length of text.
    """
    keys, only = frozenset(list_keys), frozenset(kinds) if kinds else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["artifact_id", "path", "parent_path", "group_path", "field", "ordinal", "kind", "value"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows: list[tuple] = []
        size = 0  # of paths, which are long in deep payloads
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                try:
                    record = loads(text)
                except ValueError:
                    continue
                for row in walk(record, keys, only):
                    rows.append((rid, *row))
                    size += len(row[0])
                    if len(rows) >= 20_000 or size > 8_000_000:
                        yield pack(rows)
                        rows, size = [], 0
        if rows:
            yield pack(rows)

    return df.select(F.col(id_col).cast("long").alias("i"), F.col(payload).cast("string").alias("p")).mapInArrow(parse, TRIPLES)


ROWS = "artifact_id bigint, row_path string, group_path string, ordinal bigint, parent_path string, fields map<string,string>, lists map<string,array<string>>"
_MAPS = (pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.list_(pa.string())))


def pivoted(triples: Iterator[tuple]) -> list[list]:
    """[row_path, group_path, ordinal, parent_path, fields, lists] of each repeated object in one record's triples."""
    # what lies in an object follows it at once, so of objects with one path (keys may hold dots) the last is the parent
    out: list[list] = []
    last: dict[str, list] = {}
    for path, parent, group, field, ordinal, kind, value in triples:
        if kind == "object":
            if ordinal is not None:
                row = last[path] = [path, f"{group}.{field}[]" if field else f"{group}[]", ordinal, parent, {}, {}]
                out.append(row)
        elif kind != "list" and parent != "$":
            if ordinal is None:
                last[parent][4][field] = value
            else:
                last[parent][5].setdefault(field, []).append(value)
    return out


def group_rows(df: DataFrame, id_col: str = "artifact_id", payload: str = "payload", list_keys: Sequence[str] = ()) -> DataFrame:
    """All groups pivoted: a row per repeated object of every record, with its own and its parent's path.

    Columns: ``artifact_id``, ``row_path``, ``group_path`` (its own), ``ordinal``, ``parent_path``, ``fields``
    (field to scalar, as text) and ``lists`` (field to the scalars of a list, in order). A lone object or value
    outside every repeated object belongs to none of the rows. A record is parsed once, in one task, and
    its triples are grouped there, so nothing is shuffled. Cases of damaged payloads are those of ``path_triples``.
    """
    keys = frozenset(list_keys)
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *_MAPS]
    names = ["artifact_id", "row_path", "group_path", "ordinal", "parent_path", "fields", "lists"]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        *plain, fields, lists = zip(*rows)
        held = [*plain, [list(d.items()) for d in fields], [list(d.items()) for d in lists]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                try:
                    record = loads(text)
                except ValueError:
                    continue
                for row in pivoted(walk(record, keys)):
                    rows.append((rid, *row))
                    size += len(row[0])
                    if len(rows) >= 10_000 or size > 8_000_000:
                        yield pack(rows)
                        rows, size = [], 0
        if rows:
            yield pack(rows)

    return df.select(F.col(id_col).cast("long").alias("i"), F.col(payload).cast("string").alias("p")).mapInArrow(parse, ROWS)


def repeated_groups(triples: DataFrame) -> DataFrame:
    """The groups in the data: ``group_path``, ``field``, kinds seen, records and values."""
    leaf = triples.where("kind not in ('object', 'list')")
    return leaf.groupBy("group_path", "field").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.approx_count_distinct("artifact_id").alias("records"), F.count("*").alias("n_values")
    )


def flat_table(rows: DataFrame, group_path: str, fields: Sequence[str]) -> DataFrame:
    """One group of ``group_rows`` as a table: a row per repeated object, a string column per scalar field.

    Columns: ``artifact_id``, ``row_path``, ``ordinal``, ``parent_path`` and ``fields`` (dots
    become underscores). Objects without any of the fields keep a row of nulls; scalar lists below
    an object come out as JSON arrays in order. Fields are stated, not collected, so the
    plan never depends on the data. Narrow.
    """
    return _columns(rows.where(F.col("group_path") == group_path), fields)


def key_table(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """As ``flat_table``, over all groups whose last repeated key is ``key``, whatever encloses it.

    ``$.slots[]`` and ``$.result.timeline.slots[]`` are both groups of ``slots``.
    """
    return _columns(rows.where(F.col("group_path").rlike(rf"\.{re.escape(key)}(\[\])+$")), fields)


def _columns(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    # values come as text, so lists are JSON arrays of strings
    cells = [F.coalesce(F.col("fields")[f], F.to_json(F.col("lists")[f])).alias(f.replace(".", "_")) for f in fields]
    return rows.select("artifact_id", "row_path", "ordinal", "parent_path", *cells)
