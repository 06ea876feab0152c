"""Problem 1: deeply nested records as related flat tables, by shared inlining.

The first pass analyses the schema graph: element types (the root ``$``, else
the member's name) and edges between them. A type gets a table of its own if it
is repeated (below a list) or shared (below several types); every other type is
inlined into the columns of the type it is below. A recursive type needs no rule
of its own: all types are reached from the root, so each cycle is entered from
outside and holds a type with two parents, which is shared; inlining stops there.
The second pass writes one row per element of a tabled type, with its number in
the document (node) and the foreign key (source_table, delivery_id, parent_node).
What an element belongs to is read from the foreign keys alone.

Documents are irregular (lists written as JSON text, bare objects for lists of
one, wrapped envelopes), so both passes parse them in Arrow batches in Python.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members that are lists, whatever they are written as.
LIST_MEMBERS = (
    "allocations", "approvals", "remarks", "contacts", "history", "consents", "entries", "milestones", "steps",
    "tableChanges", "columns", "data_collections", "changes", "field_changes", "tables",
)

#: Names of tabled types that every task is handed whole; with more, each document is joined to the types it has.
MAX_PLAN = 50_000

ROOT = "$"


class Invalid(ValueError):
    pass


def _no_constant(name: str):
    raise Invalid(name)


def _whole(text: str):
    """An integer of any length; Python's int reads no more than some thousand digits."""
    return int(text) if len(text) < 4000 else Decimal(text)


# numbers keep the digits they are written with
_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=_whole, parse_float=Decimal)
_BLANK = json.decoder.WHITESPACE
_NUMBER = json.scanner.NUMBER_RE
_ATOMS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _load(text: str):
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _load_deep(text)
    except ValueError:
        raise Invalid from None


def _load_deep(text: str):
    """What the decoder gives, by a loop with a stack: for documents that nest deeper than it can call itself."""
    at, stack, out = 0, [], []
    blank = lambda i: _BLANK.match(text, i).end()
    place, key = out, None  # where the next value goes
    try:
        while True:
            at = blank(at)
            c = text[at]
            opened = None
            if c in "{[":
                value = opened = {} if c == "{" else []
                at += 1
            elif c == '"':
                value, at = scanstring(text, at + 1, True)
            elif c in _ATOMS and text.startswith(_ATOMS[c][0], at):
                value, at = _ATOMS[c][1], at + len(_ATOMS[c][0])
            elif m := _NUMBER.match(text, at):
                value = Decimal(m.group()) if m.group(2) or m.group(3) else _whole(m.group())
                at = m.end()
            else:
                raise Invalid
            if isinstance(place, dict):
                place[key] = value
            else:
                place.append(value)
            if opened is not None:
                stack.append(place)
                place = opened
                at = blank(at)
                if text[at] == ("}" if isinstance(place, dict) else "]"):
                    at += 1
                else:
                    if isinstance(place, dict):
                        key, at = _member(text, at, blank)
                    continue
                place = stack.pop()
            while stack:
                at = blank(at)
                c = text[at]
                at += 1
                if c == ",":
                    if isinstance(place, dict):
                        key, at = _member(text, blank(at), blank)
                    break
                if c != ("}" if isinstance(place, dict) else "]"):
                    raise Invalid
                place = stack.pop()
            else:
                if blank(at) != len(text):
                    raise Invalid
                return out[0]
    except (IndexError, ValueError):
        raise Invalid from None


def _member(text: str, at: int, blank) -> tuple[str, int]:
    if text[at] != '"':
        raise Invalid
    key, at = scanstring(text, at + 1, True)
    at = blank(at)
    if text[at] != ":":
        raise Invalid
    return key, at + 1


def read_document(text: str | None):
    """The document to read, or ``Invalid``.

    A JSON string that holds JSON is read as the inner JSON. With both members
    schema and payload only payload is read, itself perhaps JSON text. Null,
    blank and invalid text, NaN and Infinity are invalid. Nesting may be of any
    depth, numbers of any length.
    """
    if text is None:
        raise Invalid
    doc = _load(text)
    while isinstance(doc, str):
        doc = _load(doc)
    if isinstance(doc, dict) and "schema" in doc and "payload" in doc:
        doc = doc["payload"]
        while isinstance(doc, str):
            doc = _load(doc)
    return doc


def as_list(value):
    """What a list member holds: the list, JSON text of one, or a bare object as a list of one; else the value as it is."""
    inner = value
    while isinstance(inner, str):
        try:
            inner = _load(inner)
        except Invalid:
            return value
    if isinstance(inner, dict):
        return [inner]
    return inner if isinstance(inner, list) else value


@dataclass(frozen=True)
class Plan:
    """The types that have tables, besides the root; what has none is inlined. lists: the members that are lists."""

    tabled: frozenset[str] = frozenset()
    lists: frozenset[str] = field(default_factory=lambda: frozenset(LIST_MEMBERS))


def edges(doc, lists: frozenset[str], out: Counter) -> None:
    """Counts the edges (parent type, type, kind) of one document; kind is list, object or value."""
    todo = [(ROOT, doc, ROOT)]
    while todo:
        kind, value, parent = todo.pop()
        if isinstance(value, dict):
            for name, x in value.items():
                if name in lists:
                    x = as_list(x)
                if isinstance(x, list):
                    out[kind, name, "list"] += 1
                    todo.append((name, x, kind))
                elif isinstance(x, dict):
                    out[kind, name, "object"] += 1
                    todo.append((name, x, kind))
                else:
                    out[kind, name, "value"] += 1
        elif isinstance(value, list):
            for x in value:
                if isinstance(x, dict):
                    todo.append((kind, x, kind))
                elif isinstance(x, list):
                    out[kind, kind + "[]", "list"] += 1
                    todo.append((kind + "[]", x, kind))


def _text(value) -> str:
    """A value of an attribute: strings as they are, other values as JSON."""
    if isinstance(value, str):
        return value
    return str(value) if isinstance(value, Decimal) else json.dumps(value, default=str)


def shred(doc, plan: Plan, attributes: bool) -> Iterator[tuple]:
    """Rows (type, node, node_path, parent_type, parent_node, is_element, is_object, attributes) of one document.

    Rows come parents first; node counts them. node_path joins member names with
    ``.``, list positions from 0 in brackets. parent_node is the node of the
    nearest enclosing row. attributes holds the inlined members by their path
    from the row; a list whose type has no table is a value like others.
    """
    node = 0
    # type, value, path, parent type, parent node, element?
    todo = [(ROOT, doc, "", None, None, False)]
    while todo:
        kind, value, path, ptype, pnode, is_element = todo.pop()
        if isinstance(value, list):
            inner = kind + "[]"
            for i in range(len(value) - 1, -1, -1):
                x = value[i]
                if isinstance(x, list) and inner in plan.tabled:
                    todo.append((inner, x, f"{path}[{i}]", ptype, pnode, False))
                elif isinstance(x, dict) or attributes:
                    todo.append((kind, x if not isinstance(x, list) else json.dumps(x, default=str), f"{path}[{i}]", ptype, pnode, True))
            continue
        if not isinstance(value, dict):
            if attributes:
                yield kind, node, path, ptype, pnode, is_element, False, [("value", _text(value))] if value is not None else []
                node += 1
            continue
        own = [] if attributes else None
        later = []
        inline = [("", path, value)]
        while inline:
            prefix, at, x = inline.pop()
            for name, y in x.items():
                if name in plan.lists:
                    y = as_list(y)
                if isinstance(y, (list, dict)):
                    if name in plan.tabled:
                        later.append((name, y, f"{at}.{name}" if at else name, kind, node, False))
                    elif isinstance(y, dict):
                        inline.append((f"{prefix}{name}.", f"{at}.{name}" if at else name, y))
                    elif attributes:
                        own.append((prefix + name, _text(y)))
                elif attributes and y is not None:
                    own.append((prefix + name, _text(y)))
        yield kind, node, path, ptype, pnode, is_element, True, own
        node += 1
        todo.extend(reversed(later))


def followed(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Adds to each row of ``shred`` the node_path of the nearest object above that is an element of a list, '' if none.

    It is found by the foreign keys: the parent's row if that is one, else what
    holds for the parent.
    """
    near: list[str] = []
    for row in rows:
        parent = row[4]
        above = "" if parent is None else near[parent]
        near.append(row[2] if row[5] and row[6] else above)
        yield (*row, above)


def schema_graph(documents: DataFrame, lists: tuple[str, ...] = LIST_MEMBERS) -> DataFrame:
    """Edges of the schema graph: source_table, parent_type, type, kind, occurrences.

    documents: source_table, delivery_id, text. Each batch counts its own edges,
    so what is shuffled is as small as the schema.
    """
    known = frozenset(lists)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    doc = read_document(text)
                except Invalid:
                    continue
                one: Counter = Counter()
                edges(doc, known, one)
                for (parent, name, kind), n in one.items():
                    total[source, parent, name, kind] += n
            if len(total) > 100_000:
                yield _edge_batch(total)
                total = Counter()
        if total:
            yield _edge_batch(total)

    found = documents.select("source_table", "text").mapInArrow(count, "source_table string, parent_type string, type string, kind string, n bigint")
    return found.groupBy("source_table", "parent_type", "type", "kind").agg(F.sum("n").alias("occurrences"))


def _edge_batch(total: Counter) -> pa.RecordBatch:
    rows = [(*k, n) for k, n in total.items()]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.int64())], names=["source_table", "parent_type", "type", "kind", "n"])


def tabled_types(graph: DataFrame) -> DataFrame:
    """The types with tables of their own (column type): those that occur as lists and those below several types."""
    edges_ = graph.where(F.col("kind") != "value").groupBy("parent_type", "type").agg(F.bool_or(F.col("kind") == "list").alias("repeated"))
    types = edges_.groupBy("type").agg(F.count(F.lit(1)).alias("parents"), F.bool_or("repeated").alias("repeated"))
    return types.where((F.col("parents") > 1) | F.col("repeated")).select("type")


_ROWS = {
    "source_table": pa.string(), "delivery_id": pa.int64(), "table": pa.string(), "node": pa.int64(), "node_path": pa.string(), "parent_table": pa.string(), "parent_node": pa.int64(),
    "is_element": pa.bool_(), "is_object": pa.bool_(), "attributes": pa.map_(pa.string(), pa.string()), "parent_path": pa.string(),
}


def flat_rows(documents: DataFrame, tabled: DataFrame, lists: tuple[str, ...] = LIST_MEMBERS, attributes: bool = True, max_plan: int = MAX_PLAN) -> DataFrame:
    """All rows of all tables.

    Columns: source_table, delivery_id, table, node, node_path, parent_table,
    parent_node, is_element, is_object, parent_path (of the nearest object above
    that is an element of a list, '' if none) and, unless left out, attributes
    map<string,string>. The root's row has a null parent. Documents that are
    invalid give no rows; ``refused`` names them.

    Up to ``max_plan`` types (checked) are handed to every task; beyond, each
    document is joined to those of its own types that have tables. Both give the
    same rows.
    """
    schema = pa.schema([(n, t) for n, t in _ROWS.items() if attributes or n != "attributes"])
    ddl = ", ".join(f"{n} {'map<string,string>' if n == 'attributes' else {'int64': 'bigint', 'bool': 'boolean'}.get(str(schema.field(n).type), 'string')}" for n in schema.names)
    known = frozenset(lists)
    names = [r["type"] for r in tabled.limit(max_plan + 1).collect()]
    whole = Plan(frozenset(names), known) if len(names) <= max_plan else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer: list[list] = [[] for _ in schema]
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(buffer, schema, strict=True)], schema=schema)
        for batch in batches:
            for source, delivery, text, *own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    doc = read_document(text)
                except Invalid:
                    continue
                plan = whole or Plan(frozenset(own[0] or ()), known)
                for row in followed(shred(doc, plan, attributes)):
                    for column, x in zip(buffer, (source, delivery, *(row if attributes else (*row[:7], row[8]))), strict=True):
                        column.append(x)
                    if len(buffer[0]) >= 20_000:
                        yield give()
                        buffer = [[] for _ in schema]
        if buffer[0]:
            yield give()

    read = documents.select("source_table", "delivery_id", "text")
    if whole is None:
        read = read.join(_own_types(documents, tabled, known), ["source_table", "delivery_id"], "left").select(*read.columns, "types")
    return read.mapInArrow(rows, ddl)


#: Parts of the rows of one type where documents are joined to their types.
SALT = 32


def _own_types(documents: DataFrame, tabled: DataFrame, lists: frozenset[str]) -> DataFrame:
    """The tabled types each document has: source_table, delivery_id, types. A type that most documents have is joined in SALT parts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for source, delivery, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    doc = read_document(text)
                except Invalid:
                    continue
                found: Counter = Counter()
                edges(doc, lists, found)
                for name in {name for _, name, kind in found if kind != "value"}:
                    for column, x in zip(out, (source, delivery, name), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["source_table", "delivery_id", "type"])

    has = documents.select("source_table", "delivery_id", "text").mapInArrow(each, "source_table string, delivery_id bigint, type string").withColumn("salt", F.pmod(F.xxhash64("delivery_id"), F.lit(SALT)).cast("int"))
    parts = tabled.select("type", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return has.join(parts, ["type", "salt"]).groupBy("source_table", "delivery_id").agg(F.collect_list("type").alias("types"))


def refused(documents: DataFrame) -> DataFrame:
    """The documents that can't be read, each with its reason (null, blank or invalid): source_table, delivery_id, reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for source, delivery, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    read_document(text)
                except Invalid:
                    for column, x in zip(out, (source, delivery, "null" if text is None else "invalid" if text.strip() else "blank"), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["source_table", "delivery_id", "reason"])

    return documents.select("source_table", "delivery_id", "text").mapInArrow(run, "source_table string, delivery_id bigint, reason string")


def _without(names: list[str]) -> Column:
    return F.map_filter("attributes", lambda k, v: ~k.isin(*names)) if names else F.col("attributes")


def tables(documents: DataFrame, tabled: DataFrame, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The named tables with one column per named attribute; the attributes not named stay in ``rest``."""
    rows = flat_rows(documents, tabled)
    out = {}
    for name, wanted in columns.items():
        own = rows.where(F.col("table") == name)
        out[name] = own.select(
            "source_table", "delivery_id", "node", "node_path", "parent_table", "parent_node",
            *[F.col("attributes")[c].alias(c.replace(".", "_")) for c in wanted],
            _without(wanted).alias("rest"),
        )
    return out


def documents_of(raw: DataFrame, dlq: DataFrame) -> DataFrame:
    """The JSON documents of both tables: source_table, delivery_id, text."""
    return raw.select(F.lit("raw_source_event").alias("source_table"), "delivery_id", F.col("value_json").alias("text")).unionByName(
        dlq.select(F.lit("dlq").alias("source_table"), "delivery_id", F.col("original_payload").alias("text"))
    )


def p1_found(raw: DataFrame, dlq: DataFrame) -> DataFrame:
    """(source_table, delivery_id, node_path, parent_path) of each object that is an element of a list.

    The rows are those of the tables the schema graph asks for, their parents
    found by the foreign keys.
    """
    documents = documents_of(raw, dlq)
    rows = flat_rows(documents, tabled_types(schema_graph(documents)), attributes=False)
    return rows.where("is_element and is_object").select("source_table", "delivery_id", "node_path", "parent_path")
