"""Nested records into related flat tables, by shared inlining.

The method: analyse the schema graph of the records, inline elements that occur once and under one parent, give
each repeated, shared or recursive element a table of its own, and fill in the foreign keys.

Two inputs are served. JSON text, whose schema differs from row to row, is analysed by one pass that counts the
edges of its schema graph (:func:`analyse`) and shredded by another (:func:`shred_json`). Typed columns have
their graph in the DataFrame's schema, so :func:`shred_column` needs no pass of its own.

Keys that are really data (an object with more than ``MAP_KEYS`` different keys in the whole table) would make the schema
as large as the data: such an object is a map, and its nested values are elements ``<element>_entry`` of a table of their
own, each with its key. Records of any depth are walked without recursion.

Defined results: null, blank or unreadable JSON gives no rows; an empty table gives empty tables; JSON that is encoded as
a JSON string, however often, is unwrapped, and of a list each record is taken, with a root of its own; repeated rows
give repeated nodes, which the caller's key tells apart or folds; columns other than the key and the payload are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = "record"
#: Different keys of an element from which on they count as data, and edges of the graph that come to the driver at most.
MAP_KEYS = 1_000
MAX_EDGES = 20_000
#: Different edges that a task holds before it hands its counts on.
HELD_EDGES = 100_000
#: Characters of a node's path from which on it is a hash and what follows it.
LONG_PATH = 256
#: Places in lists that a node's ``ordinals`` have at most, from the outermost inwards; its key tells it apart at any depth.
LONG_PLACES = 100
#: The field of an entry of a map that has its key.
KEY = "@key"
NODES = T.StructType(
    [
        T.StructField("relation", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("parent_relation", T.StringType()),
        T.StructField("parent_node", T.StringType()),
        T.StructField("record_node", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ordinals", T.ArrayType(T.IntegerType())),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class Names:
    """How keys become elements: ``aliases`` maps a key to its element; ``transparent`` objects are looked through.

    The fields of an object under a key in ``copied`` are the parent's too (dotted), also where it has a table of its
    own, so that what is read there doesn't depend on the other records of the table. The keys of the elements in
    ``maps`` are data.
    """

    aliases: Mapping[str, str] = field(default_factory=dict)
    transparent: frozenset[str] = frozenset()
    copied: frozenset[str] = frozenset()
    maps: frozenset[str] = frozenset()

    def element(self, key: str, parent: str) -> str:
        if parent in self.maps:
            return nested_name(parent, "_entry")
        return self.aliases.get(key, key)


def nested_name(element: str, suffix: str) -> str:
    """The element of what lies in a list's list, or in a map; one name for all depths."""
    return element if element.endswith(suffix) else element + suffix


@dataclass(frozen=True)
class Plan:
    """The elements with a table of their own, and why."""

    relations: Mapping[str, str]


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|([^\s{}\[\],:"]+))', re.S)


def _loads(text: str) -> object:
    """As json.loads, at any depth."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    top: list = []
    stack: list[tuple[list | dict, str | None]] = [(top, None)]
    # What may come next: a value, a key, a colon, or a comma or end; a value or key may be an end right after the opening.
    wants, opened, at, end = "value", False, 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, quoted, bare = m.groups()
        holder, key = stack[-1]
        if mark in ("}", "]"):
            if len(stack) == 1 or isinstance(holder, dict) != (mark == "}") or not (wants == "comma" or opened):
                raise ValueError(f"no JSON at {at}")
            stack.pop()
            wants, opened = "comma", False
        elif mark == "," and wants == "comma" and len(stack) > 1:
            wants, opened = ("key" if isinstance(holder, dict) else "value"), False
        elif mark == ":" and wants == "colon":
            wants = "value"
        elif wants == "key" and quoted:
            stack[-1] = (holder, json.loads(quoted))
            wants, opened = "colon", False
        elif wants == "value" and (mark in ("{", "[") or quoted or bare):
            value = {} if mark == "{" else [] if mark == "[" else json.loads(quoted or bare)
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            wants, opened = "comma", False
            if mark:
                stack.append((value, None))
                wants, opened = ("key" if mark == "{" else "value"), True
        else:
            raise ValueError(f"no JSON at {at}")
    if len(stack) > 1 or len(top) != 1:
        raise ValueError("JSON ends early")
    return top[0]


def records_of(text: str | None) -> list[dict]:
    """The records of a payload, in order: unwrapped from JSON strings and lists."""
    out: list[dict] = []
    todo: list[object] = [text]
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            out.append(value)
        elif isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, str):
            try:
                todo.append(_loads(value))
            except ValueError:
                pass
    return out


def _scalar(value: object) -> str | None:
    if isinstance(value, str) or value is None:
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return None


def _clean(value: str | None) -> str | None:
    """Without halves of characters, which JSON escapes may leave."""
    return value if value is None or value.isascii() else value.encode("utf-8", "replace").decode()


def _flat(value: object) -> bool:
    """A list of scalars only: one set-valued field, not a list of elements."""
    return isinstance(value, list) and not any(isinstance(x, (dict, list)) for x in value)


def _nested(value: object) -> bool:
    return isinstance(value, dict) or isinstance(value, list) and not _flat(value)


def _edges(record: dict, names: Names, count: dict) -> None:
    todo: list[tuple[object, str]] = [(record, ROOT)]
    while todo:
        value, element = todo.pop()
        if isinstance(value, dict):
            for key, child in value.items():
                if key in names.transparent and isinstance(child, dict):
                    todo.append((child, element))
                elif _nested(child):
                    name = names.element(key, element)
                    edge = (element, name, isinstance(child, list) or element in names.maps)
                    count[edge] = count.get(edge, 0) + 1
                    todo.append((child, name))
        elif isinstance(value, list):
            for child in value:
                if isinstance(child, list):
                    name = nested_name(element, "_item")
                    count[element, name, True] = count.get((element, name, True), 0) + 1
                    todo += [(x, name) for x in child if _nested(x)]
                elif isinstance(child, dict):
                    todo.append((child, element))


def schema_graph(df: DataFrame, payload: str, names: Names = Names()) -> DataFrame:
    """One row per edge of the records' schema graph: parent, child, whether the child repeats, and how often.

    Counted within each task before the shuffle, so what moves is of the size of the schema, not of the data.
    """
    schema = pa.schema([("parent", pa.string()), ("child", pa.string()), ("repeated", pa.bool_()), ("n", pa.int64())])

    def rows(edges: dict[tuple[str, str, bool], int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"parent": _clean(p), "child": _clean(c), "repeated": r, "n": n} for (p, c, r), n in edges.items()], schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: dict[tuple[str, str, bool], int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for record in records_of(text):
                    _edges(record, names, edges)
                if len(edges) > HELD_EDGES:
                    yield rows(edges)
                    edges = {}
        yield rows(edges)

    found = df.select(F.col(payload).cast("string")).mapInArrow(count, "parent string, child string, repeated boolean, n bigint")
    return found.groupBy("parent", "child", "repeated").agg(F.sum("n").alias("n"))


def plan_inlining(edges: list[Row], always: Iterable[str] = ()) -> Plan:
    """The relations of shared inlining: elements that repeat, have several parents, or contain themselves.

    ``edges`` are the rows of a :func:`schema_graph`. Those in ``always`` get a table whatever the records hold.
    """
    children: dict[str, set[str]] = {}
    parents: dict[str, set[str]] = {}
    repeated = {e.child for e in edges if e.repeated}
    for e in edges:
        children.setdefault(e.parent, set()).add(e.child)
        parents.setdefault(e.child, set()).add(e.parent)

    def reaches_itself(start: str) -> bool:
        seen, todo = set(), list(children.get(start, ()))
        while todo:
            at = todo.pop()
            if at == start:
                return True
            if at not in seen:
                seen.add(at)
                todo += children.get(at, ())
        return False

    why = {ROOT: "root"} | dict.fromkeys(always, "asked for")
    for name in sorted(parents):
        reasons = [word for word, holds in (("repeated", name in repeated), ("shared", len(parents[name]) > 1), ("recursive", reaches_itself(name))) if holds]
        if reasons:
            why[name] = "+".join(reasons)
    return Plan(why)


def analyse(df: DataFrame, payload: str, names: Names = Names(), always: Iterable[str] = (), map_keys: int = MAP_KEYS, max_edges: int = MAX_EDGES) -> tuple[Names, Plan]:
    """The names, with the maps among the elements, and the plan: the analysis of records whose keys may be data.

    The graph is counted again whenever maps were found, as folding their keys shows what lies below. At most
    ``max_edges`` edges come to the driver: where there are more, fewer keys make a map.
    """
    while True:
        graph = schema_graph(df, payload, names).persist()
        edges = graph.limit(max_edges + 1).collect()
        if len(edges) <= max_edges:
            wide = [p for p, n in Counter(p for p, _ in {(e.parent, e.child) for e in edges}).items() if n > map_keys and p not in names.maps]
            if not wide:
                plan = plan_inlining(edges, always)
                graph.unpersist()
                return names, plan
        else:
            counts = graph.where(~F.col("parent").isin(*names.maps)).groupBy("parent").agg(F.countDistinct("child").alias("n"))
            wide = [r.parent for r in counts.where(F.col("n") > map_keys).orderBy(F.desc("n"), "parent").limit(MAP_KEYS).collect()]
            map_keys = map_keys if wide else map_keys // 2
        names = replace(names, maps=names.maps | set(wide))
        graph.unpersist()


def _key(path: str) -> str:
    """A node's key: its path in the record, of bounded length."""
    return path if len(path) <= LONG_PATH else "#" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest()


def _shred(record: dict, root: str, names: Names, plan: Plan) -> list[tuple]:
    """The nodes of one record. A node's path in the record is its key; its parent is the nearest ancestor with a table."""
    nodes: list[tuple] = []
    # Each with the element and key of the node that what is inlined belongs to, and that node's places and fields.
    todo: list[tuple] = []

    def add(element: str, path: str, parent: tuple[str | None, str | None], ordinals: tuple[int, ...], value: object, key: str | None = None) -> None:
        fields: dict[str, str | None] = {} if key is None else {KEY: key}
        kind = "object" if isinstance(value, dict) else "list" if isinstance(value, list) else "scalar"
        path, ordinals = _key(path), ordinals[:LONG_PLACES]
        nodes.append((element, path, *parent, root, kind, ordinals, fields))
        if kind == "object":
            todo.append((value, element, "", path, (element, path), ordinals, fields))
        elif _nested(value):
            name = nested_name(element, "_item")
            if name in plan.relations:
                todo.append((value, name, None, path, (element, path), ordinals, fields))
        else:
            fields[""] = _scalar(value)

    def copy(value: dict, prefix: str, fields: dict) -> None:
        rest = [value]
        while rest:
            for key, item in rest.pop().items():
                if key in names.transparent and isinstance(item, dict):
                    rest.append(item)
                elif not _nested(item):
                    fields[f"{prefix}{key}"] = _scalar(item)

    def inline(value: dict, element: str, prefix: str, path: str, home: tuple[str, str], ordinals: tuple[int, ...], fields: dict) -> None:
        for place, (key, item) in enumerate(value.items()):
            name, at = names.element(key, element), f"{path}.{key}"
            if key in names.transparent and isinstance(item, dict):
                todo.append((item, element, prefix, _key(at), home, ordinals, fields))
            elif element in names.maps:
                if not _nested(item):
                    fields[f"{prefix}{key}"] = _scalar(item)
                elif name in plan.relations and isinstance(item, list):
                    for i, x in enumerate(item):
                        if x is not None:
                            add(name, f"{at}[{i}]", home, (*ordinals, place, i), x, key)
                elif name in plan.relations:
                    add(name, at, home, (*ordinals, place), item, key)
            elif name in plan.relations and item is not None:
                if isinstance(item, list) and not _flat(item):
                    for i, x in enumerate(item):
                        if x is not None:
                            add(name, f"{at}[{i}]", home, (*ordinals, i), x)
                elif isinstance(item, dict):
                    add(name, at, home, ordinals, item)
                    if key in names.copied:
                        copy(item, f"{prefix}{key}.", fields)
                elif not isinstance(item, list):
                    # The node that other records need here, and the field that this parent has.
                    add(name, at, home, ordinals, item)
                    fields[f"{prefix}{key}"] = _scalar(item)
                elif item:
                    fields[f"{prefix}{key}"] = _scalar(item)
            elif isinstance(item, dict):
                todo.append((item, name, f"{prefix}{key}.", _key(at), home, ordinals, fields))
            else:
                fields[f"{prefix}{key}"] = _scalar(item)

    add(ROOT, root, (None, None), (), record)
    while todo:
        value, element, prefix, path, home, ordinals, fields = todo.pop()
        if prefix is not None:
            inline(value, element, prefix, path, home, ordinals, fields)
        else:
            for i, item in enumerate(value):
                if item is not None:
                    add(element, f"{path}[{i}]", home, (*ordinals, i), item)
    return nodes


def shred_json(df: DataFrame, keys: list[str], payload: str, names: Names = Names(), plan: Plan | None = None, relations: list[str] | None = None) -> DataFrame:
    """All nodes of the records in one pass: the key columns, then the columns of ``NODES``.

    (key columns, node) identifies a row; (key columns, parent_node) is the foreign key to its parent's row, and
    ``record_node`` that to its record's. ``relations`` limits what is put out. Fields of inlined objects have dotted
    names; a list of scalars is one field with its JSON text. Without a plan the records are analysed first.
    """
    if plan is None:
        names, plan = analyse(df, payload, names)
    wanted = set(relations) if relations is not None else set(plan.relations)
    source = df.select(*(F.col(k) for k in keys), F.col(payload).cast("string").alias("__payload"))
    schema = T.StructType([*source.schema.fields[:-1], *NODES.fields])
    kinds = {"ordinals": pa.list_(pa.int32()), "fields": pa.map_(pa.string(), pa.string())}
    node_type = pa.schema([(f.name, kinds.get(f.name, pa.string())) for f in NODES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                records = records_of(text)
                for n, record in enumerate(records):
                    for node in _shred(record, "$" if len(records) == 1 else f"$[{n}]", names, plan):
                        if node[0] in wanted:
                            at.append(i)
                            rows.append((*map(_clean, node[:6]), node[6], [(_clean(k), _clean(v)) for k, v in node[7].items()]))
            take = pa.array(at, pa.int64())
            columns = [batch.column(k).take(take) for k in range(len(keys))]
            columns += [pa.array([row[k] for row in rows], kind.type) for k, kind in enumerate(node_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[: len(keys)]), *node_type.names])

    return source.mapInArrow(run, schema)


def relation_table(nodes: DataFrame, keys: list[str], relation: str, fields: list[str]) -> DataFrame:
    """One flat table: the key, the node, its parent's key and the named fields as columns (dots become ``_``)."""
    columns = [F.col("fields").getItem(name).alias(name.replace(".", "_") or "value") for name in fields]
    return nodes.where(F.col("relation") == relation).select(*keys, "node", "parent_relation", "parent_node", "ordinals", *columns)


def _flatten(value: Column, kind: T.StructType, prefix: str = "") -> tuple[list[Column], list[tuple[str, Column, T.DataType]]]:
    columns, arrays = [], []
    for f in kind.fields:
        at, name = value.getField(f.name), f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            more, lists = _flatten(at, f.dataType, f"{name}_")
            columns += more
            arrays += lists
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StructType, T.ArrayType)):
            arrays.append((name, at, f.dataType))
        else:
            columns.append(at.alias(name))
    return columns, arrays


def shred_column(df: DataFrame, keys: list[str], column: str) -> dict[str, DataFrame]:
    """The flat tables of a typed nested column, by element name.

    Each has the key, ``ordinals`` (the positions from the outermost list inwards: with the key, its own key; without
    the last, its parent's) and its inlined fields. Null elements are counted but give no row.
    """
    tables: dict[str, DataFrame] = {}

    def visit(source: DataFrame, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.ArrayType):
            rows = source.select(*keys, "ordinals", F.posexplode("value").alias("pos", "element"))
            rows = rows.where(F.col("element").isNotNull()).select(*keys, F.concat("ordinals", F.array("pos")).alias("ordinals"), F.col("element").alias("value"))
            if isinstance(kind.elementType, T.ArrayType):
                return visit(rows, f"{name}_item", kind.elementType)
            source, kind = rows, kind.elementType
        if isinstance(kind, T.StructType):
            columns, arrays = _flatten(F.col("value"), kind)
            tables[name] = source.select(*keys, "ordinals", *columns)
            for child, at, child_kind in arrays:
                visit(source.select(*keys, "ordinals", at.alias("value")), f"{name}_{child}", child_kind)
        else:
            tables[name] = source.select(*keys, "ordinals", "value")

    visit(df.select(*keys, F.array().cast("array<int>").alias("ordinals"), F.col(column).alias("value")), column, df.schema[column].dataType)
    return tables
