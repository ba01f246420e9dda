"""Shredding of nested records into an adjacency table and from it into flat entity tables.

``shred_json`` turns one JSON document per row into rows (document, node, parent, label, ordinal,
kind, value). ``pivot_objects`` puts the scalar children of each object node side by side, so every
kind of nested object becomes a flat table whose rows name their parent row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ADJACENCY = "node int, parent int, owner int, label string, list_label string, ordinal int, place string, kind string, value string"
_DIGITS = frozenset("0123456789")


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_WORD = re.compile("|".join(_WORDS))


def parse_deep(text: str):
    """The value of a JSON text of any depth, read with a stack of its own; ValueError if it is not complete JSON."""
    root: list = []
    # Open lists and objects, the latter with the key whose value is being read.
    stack: list[list] = [[root, None]]
    at, expect = _BLANK.match(text, 0).end(), "value"
    while True:
        sign = text[at : at + 1]
        if expect in ("key", "first key"):
            if sign == "}" and expect == "first key":
                stack.pop()
                at, expect = at + 1, "next"
            elif sign == '"':
                key, at = scanstring(text, at + 1, True)
                at = _BLANK.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError(f"no colon at {at}")
                stack[-1][1] = key
                at, expect = at + 1, "value"
            else:
                raise ValueError(f"no key at {at}")
        elif expect == "next":
            holder = stack[-1][0]
            if holder is root:
                if at < len(text):
                    raise ValueError(f"more text at {at}")
                return root[0]
            if sign == ",":
                expect = "key" if isinstance(holder, dict) else "value"
            elif sign == ("}" if isinstance(holder, dict) else "]"):
                stack.pop()
            else:
                raise ValueError(f"no end at {at}")
            at += 1
        else:
            if sign == "]" and expect == "first value":
                stack.pop()
                at, expect = at + 1, "next"
            else:
                opened = None
                if sign == "{":
                    value, at, opened = {}, at + 1, "first key"
                elif sign == "[":
                    value, at, opened = [], at + 1, "first value"
                elif sign == '"':
                    value, at = scanstring(text, at + 1, True)
                elif m := _NUMBER.match(text, at):
                    value, at = float(m[0]) if m[1] or m[2] else int(m[0]), m.end()
                elif m := _WORD.match(text, at):
                    value, at = _WORDS[m[0]], m.end()
                else:
                    raise ValueError(f"no value at {at}")
                holder, key = stack[-1]
                if isinstance(holder, dict):
                    holder[key] = value
                else:
                    holder.append(value)
                if opened:
                    stack.append([value, None])
                expect = opened or "next"
        at = _BLANK.match(text, at).end()


def parse(text: str):
    """The value of a JSON text; ValueError if it is not complete JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        return parse_deep(text)


def _unwrap(text: str):
    """The object or array that a string holds in JSON, or the string itself."""
    head = text.lstrip()[:1]
    if head in ("{", "["):
        try:
            return parse(text)
        except ValueError:
            return text
    return text


def _numbered(value: dict) -> bool:
    return bool(value) and all(k and not set(k) - _DIGITS for k in value)


def adjacency_rows(text: str | None, as_list: frozenset[str] = frozenset(), keep: frozenset[str] | None = None) -> Iterator[tuple]:
    """Nodes of one document in document order, the root first.

    ``owner`` is the nearest object above a node, ``list_label`` the label of the list that an element
    stands in and ``place`` the dotted positions of the lists above it. Objects whose keys are all
    digits count as lists in the order of these numbers, JSON in a string counts as that JSON, and a
    lone object below a label of ``as_list`` as a list of one. ``keep`` limits the scalars that are
    given to some labels and leaves arrays out; nodes have the same numbers whatever is kept. Null gives
    no rows, text that is not complete JSON one row of kind 'broken'.
    """
    if text is None:
        return
    try:
        root = parse(text)
    except ValueError:
        yield 0, None, None, None, None, 0, "", "broken", None
        return
    if isinstance(root, str):
        root = _unwrap(root)
    count = 0
    # (value, parent, owner, label, list_label, ordinal, place)
    stack = [(root, None, None, None, None, 0, "")]
    while stack:
        value, parent, owner, label, list_label, ordinal, place = stack.pop()
        if isinstance(value, str):
            value = _unwrap(value)
        if isinstance(value, dict) and label in as_list and list_label is None and not _numbered(value):
            value = [value]
        if isinstance(value, dict) and not _numbered(value):
            node, count = count, count + 1
            yield node, parent, owner, label, list_label, ordinal, place, "object", None
            stack += reversed([(v, node, node, k, None, i, place) for i, (k, v) in enumerate(value.items())])
        elif isinstance(value, (dict, list)):
            node, count = count, count + 1
            if keep is None:
                yield node, parent, owner, label, list_label, ordinal, place, "array", None
            items = value if isinstance(value, list) else [value[k] for k in sorted(value, key=lambda k: (int(k), k))]
            stack += reversed([(v, node, owner, label, label, i, f"{place}.{i}" if place else str(i)) for i, v in enumerate(items)])
        else:
            node, count = count, count + 1
            if keep is not None and label not in keep:
                continue
            if value is None:
                kind, scalar = "null", None
            elif isinstance(value, bool):
                kind, scalar = "boolean", "true" if value else "false"
            elif isinstance(value, (int, float)):
                kind, scalar = "number", repr(value)
            else:
                kind, scalar = "string", value
            yield node, parent, owner, label, list_label, ordinal, place, kind, scalar


def shred_json(df: DataFrame, key: str, payload: str, as_list: Iterable[str] = (), keep: Iterable[str] | None = None, batch_rows: int = 20_000) -> DataFrame:
    """Adjacency table of the documents in ``payload``: key, doc (digest of the text) and ADJACENCY.

    A record delivered again with the same text has the same node numbers, so its rows are repeated
    rows and fall together in ``pivot_objects``. Other columns of ``df``, also ones named like those given
    here, are ignored. A document is read in one task, in time linear in its size at any depth; the task
    holds one document and ``batch_rows`` rows, or 32 MB of places, at a time.
    """
    key_type = df.schema[key].dataType.simpleString()
    lists, wanted = frozenset(as_list), None if keep is None else frozenset(keep)
    schema = f"record {key_type}, doc bigint, {ADJACENCY}"
    slim = df.select(F.col(key).alias("record"), F.xxhash64(F.col(payload)).alias("doc"), F.col(payload).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            types = types or pa.schema(
                [("record", batch.schema.field("record").type), ("doc", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("owner", pa.int32()), ("label", pa.string()), ("list_label", pa.string()), ("ordinal", pa.int32()), ("place", pa.string()), ("kind", pa.string()), ("value", pa.string())]
            )
            rows: list[tuple] = []
            held = 0
            for record, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for row in adjacency_rows(text, lists, wanted):
                    rows.append((record, doc, *row))
                    held += len(row[6])
                    if len(rows) >= batch_rows or held > 1 << 25:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

    return slim.mapInArrow(run, schema)


def pivot_objects(adjacency: DataFrame, scalars: dict[str, str]) -> DataFrame:
    """One row per object node with its scalar children: record, doc, node, owner, label, list_label, place and ``scalars``.

    ``scalars`` maps a column name to the label of the scalar; lists of scalars are not scalars. An
    object and its scalar children meet in one aggregation by (record, doc, object), which is the
    join of object nodes with their scalars and the pivot at once; repeated rows change nothing.
    """
    is_object = F.col("kind") == "object"
    own = F.col("list_label").isNull()

    def child(label: str) -> Column:
        return F.max(F.when(~is_object & own & (F.col("label") == label), F.col("value")))

    flat = adjacency.where(is_object | ~F.col("kind").isin("array", "broken"))
    keyed = flat.withColumn("object", F.when(is_object, F.col("node")).otherwise(F.col("parent")))
    return (
        keyed.groupBy("record", "doc", F.col("object").alias("node"))
        .agg(
            F.max(F.when(is_object, F.col("owner"))).alias("owner"),
            F.max(F.when(is_object, F.col("label"))).alias("label"),
            F.max(F.when(is_object, F.col("list_label"))).alias("list_label"),
            F.max(F.when(is_object, F.col("place"))).alias("place"),
            F.max(is_object.cast("int")).alias("has_object"),
            *(child(label).alias(name) for name, label in scalars.items()),
        )
        .where("has_object = 1")
        .drop("has_object")
    )


FLOW = {"flow_id": "id", "name": "name", "flow_kind": "flow_kind", "entry_point_id": "entry_point_id", "criticality": "criticality"}
EFFECTS = ["entities_written", "entities_read", "external_services", "messages_emitted"]


def flow_adjacency(flows: DataFrame, keep: Iterable[str] | None = None) -> DataFrame:
    """Adjacency table of flow payloads (record_id, payload). Written once, it serves all tables made from it."""
    return shred_json(flows, "record_id", "payload", as_list=["steps"], keep=keep)


def flow_objects(flows: DataFrame, scalars: dict[str, str]) -> DataFrame:
    """Objects of flow payloads (record_id, payload) with some of their scalars."""
    return pivot_objects(flow_adjacency(flows, set(scalars.values())), scalars)


def steps_of(adjacency: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Steps at any depth: record, doc, node, owner, step_path, parent_node_id, node_id and ``extra`` scalars.

    The parent of a top step is the handler of the entry, written as ``handler_node_id`` or as a
    ``handler`` object; '' stands for a parent without an id. Steps without a node_id are kept with a
    null node_id. Each step is joined with the object above it on (record, doc, owner = node): both stand
    side by side in one sorted run per object, first the object (at the root also the handlers), then its steps,
    so that the join needs no shuffle beyond the one by document that the pivot needs, time linear in
    the number of steps, and no object's steps in memory.
    """
    names = {"node_id": "node_id", "handler_node_id": "handler_node_id", **(extra or {})}
    objects = pivot_objects(adjacency.repartition("record", "doc"), names)
    lone = F.col("list_label").isNull()
    handler = F.when(lone & (F.col("label") == "entry"), F.col("handler_node_id")).when(lone & (F.col("label") == "handler"), F.col("node_id"))
    is_step, is_root = F.col("list_label") == "steps", F.col("owner").isNull() & F.col("label").isNull()
    none = F.lit(None).cast("string")
    # The root of a complete document has number 0.
    roles = F.array(
        F.when(handler.isNotNull(), F.struct(F.lit(0).alias("link"), F.lit(0).alias("role"), handler.alias("handler"), none.alias("above"))),
        F.when(is_step | is_root, F.struct(F.col("node").alias("link"), F.lit(1).alias("role"), none.alias("handler"), F.when(is_step, F.col("node_id")).alias("above"))),
        F.when(is_step, F.struct(F.col("owner").alias("link"), F.lit(2).alias("role"), none.alias("handler"), none.alias("above"))),
    )
    rows = objects.select("record", "doc", "node", "owner", "place", "node_id", *(extra or {}), F.inline(F.array_compact(roles)))
    run = W.partitionBy("record", "doc", "link").orderBy("role").rowsBetween(W.unboundedPreceding, W.currentRow)
    parent = F.when(F.col("link") == 0, F.max("handler").over(run)).otherwise(F.max("above").over(run))
    joined = rows.withColumn("parent_node_id", F.coalesce(parent, F.lit(""))).where("role = 2")
    return joined.select("record", "doc", "node", "owner", F.col("place").alias("step_path"), "parent_node_id", "node_id", *(extra or {}))


def flow_steps(flows: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """``steps_of`` the payloads, of which only what it needs is given to Spark."""
    return steps_of(flow_adjacency(flows, {"node_id", "handler_node_id", *(extra or {}).values()}), extra)


def flows_of(adjacency: DataFrame) -> DataFrame:
    """Flows: record_id, flow_id, name, flow_kind, entry_point_id; the root object of each complete payload."""
    root = (F.col("kind") == "object") & F.col("owner").isNull() & F.col("label").isNull()
    objects = pivot_objects(adjacency.where(root | (F.col("owner") == 0)), FLOW)
    return objects.where("owner is null and label is null").select(F.col("record").alias("record_id"), *FLOW).distinct()


def flow_table(flows: DataFrame) -> DataFrame:
    """``flows_of`` the payloads."""
    return flows_of(flow_adjacency(flows, set(FLOW.values())))


def effects_of(adjacency: DataFrame) -> DataFrame:
    """Effects of flows: record_id, effect (list of terminal_effects), position, entity, and the object that holds the list.

    ``owner`` is the object's number in the document, by which steps and flows (number 0) are named too.
    """
    listed = adjacency.where(F.col("list_label").isin(EFFECTS) & F.col("value").isNotNull())
    return listed.select(F.col("record").alias("record_id"), "owner", F.col("list_label").alias("effect"), F.col("ordinal").alias("position"), F.col("value").alias("entity")).distinct()


def flow_effects(flows: DataFrame) -> DataFrame:
    """``effects_of`` the payloads."""
    return effects_of(flow_adjacency(flows, EFFECTS))


def broken_documents(flows: DataFrame) -> DataFrame:
    """record_id of the payloads that are not complete JSON, which have no rows in the other tables; null payloads are none."""
    return flow_adjacency(flows, ()).where("kind = 'broken'").select(F.col("record").alias("record_id")).distinct()


def node_sources(nodes: DataFrame) -> DataFrame:
    """Source places of nodes: analysis_id, node_id (the parent) and the fields of the source struct; nodes without one are left out."""
    place = F.col("source")
    return nodes.where(place.isNotNull()).select("analysis_id", F.col("id").alias("node_id"), place["file"].alias("file"), place["line"].alias("line"), place["end_line"].alias("end_line")).distinct()


def node_parameters(nodes: DataFrame) -> DataFrame:
    """Parameters of signatures: analysis_id, node_id (the parent), position and the parameter's fields."""
    exploded = nodes.select("analysis_id", F.col("id").alias("node_id"), F.posexplode("signature.parameters").alias("position", "p"))
    return exploded.select("analysis_id", "node_id", "position", F.col("p.name").alias("name"), F.col("p.type").alias("type"), F.col("p.optional").alias("optional")).distinct()
