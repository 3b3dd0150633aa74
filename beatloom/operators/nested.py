"""Flattening deeply nested payloads into related tables by interval labels.

A depth-first walk numbers every node of a payload (objects, arrays, scalars) on
entry (``pre``) and on exit (``post``). A node lies below another exactly when
its interval lies inside the other's, so the typed tables need no foreign keys
of their own: parent and child meet by interval containment. All nodes of a
payload lie in one Arrow batch, so containment is settled there, by one sorted
look-up for all nodes of the batch, and nothing is shuffled. Nodes of one linked
type (beats, visuals) do not nest in each other, so the containing node is the
last one of that type entered before, confirmed by its ``post``.

Kinds: ``payload`` and ``envelope`` (what stands around the beats), ``beat``,
``visual``, ``entity``, ``action``, ``context``, ``overlay``, ``last_resort``,
and below or beside them ``list``, ``object`` and ``value``.

Defined cases: null, blank, ``null`` and incomplete payloads give no rows.
Text around the JSON, code fences and JSON strings that hold JSON (any number
of layers) are opened. Payloads of one ``raw_id`` stay apart, wherever they lie:
``copy`` numbers the rows of the input. Beats, visuals and entities of an
unexpected shape (numbers, booleans) are read as text; null ones give no row but
keep their position. Payloads nested beyond the interpreter's limit count as
incomplete; empty tables and other columns of any name do not matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of a beat whose objects become nodes.
VISUALS = ("primary_visual", "fallback_visual")
OVERLAY = "text_overlay"
#: Fields whose members are nodes of a kind of their own, by the kind of node that holds them.
MEMBERS = {"beat": {**dict.fromkeys(VISUALS, "visual"), OVERLAY: "overlay", "last_resort": "last_resort"}, "visual": {"entities": "entity", "actions": "action", "context": "context"}}
#: Kinds that other nodes are linked to.
LINKED = ("beat", "visual")
#: Payloads labelled at a time; a bound of memory only.
SLICE = 200

NODE_SCHEMA = "raw_id bigint, copy bigint, pre bigint, post bigint, kind string, node string, pos bigint, value string, beat_pre bigint, beat_pos bigint, visual_pre bigint, visual_pos bigint, visual_node string"

_OPEN = re.compile(r"[\[{]")
_BEAT_KEYS = {"beat_id", "beat_number", "narration_verbatim", *VISUALS, OVERLAY}


def parse_payload(text: str | None):
    """The JSON container a producer sent, or None if there is none or it is incomplete."""
    if text is None:
        return None
    text = text.strip().lstrip("﻿")
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return _embedded(text)
    return parse_payload(value) if isinstance(value, str) else value if isinstance(value, (dict, list)) else None


def _embedded(text: str):
    """The first JSON container inside other text.

    A bracket that opens nothing (as in running text) is passed over; one that
    opens a container which then breaks off makes the payload incomplete, so
    that its inner parts are not taken for the whole.
    """
    decoder = json.JSONDecoder()
    for m in _OPEN.finditer(text):
        try:
            value, _ = decoder.raw_decode(text, m.start())
        except json.JSONDecodeError as e:
            if e.pos > m.start() + 1:
                return None
            continue
        except RecursionError:
            return None
        if value:
            return value
    return None


def _opened(value):
    """A field that may be a container written as a JSON string."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            return value
        return inner if isinstance(inner, (dict, list)) else value
    return value


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _is_beat(key: str | None, value) -> bool:
    return key == "[]" and isinstance(value, dict) and bool(_BEAT_KEYS & value.keys()) and "beats" not in value


def beats_of(root) -> list:
    """The beats of a payload in order, wherever its envelope keeps them."""
    found: list = []
    stack = [("", root)]
    while stack:
        key, value = stack.pop()
        if _is_beat(key, value):
            found.append(value)
        elif isinstance(value, dict):
            stack.extend((k, _opened(v) if k == "beats" else v) for k, v in reversed(list(value.items())))
        elif isinstance(value, list):
            stack.extend(("[]", v) for v in reversed(value))
    return found


def _shown(kind: str, value) -> str | None:
    """What a node's row says of it."""
    if kind == "beat":
        return value["beat_id"] if isinstance(value.get("beat_id"), str) else None
    if kind == "visual":
        return value["media_type"] if isinstance(value, dict) and isinstance(value.get("media_type"), str) else None
    if kind in ("entity", "overlay", "last_resort") and isinstance(value, dict):
        value = value.get("name" if kind == "entity" else "content")
    if value is None or kind in ("payload", "envelope", "list", "object"):
        return None
    return _text(value)


def _members(kind: str, node: str | None, value, members: str | None) -> Iterator[tuple]:
    """``(kind, node, pos, value, kind of the members)`` of what lies directly below a node."""
    if isinstance(value, list):
        for i, v in enumerate(value):
            if kind in ("payload", "envelope"):
                yield "beat" if _is_beat("[]", v) else "envelope" if isinstance(v, (dict, list)) else "value", "[]", i, v, None
            elif members:
                yield members if v is not None else "value", node, i, _opened(v) if members == "visual" else v, None
            else:
                yield "list" if isinstance(v, list) else "object" if isinstance(v, dict) else "value", node, i, v, None
    elif isinstance(value, dict):
        for k, v in value.items():
            if kind in ("payload", "envelope"):
                v = _opened(v) if k == "beats" else v
                yield "envelope" if isinstance(v, (dict, list)) else "value", k, 0, v, None
                continue
            own = MEMBERS.get(kind, {}).get(k)
            v = _opened(v) if own else v
            if own and v is not None and not isinstance(v, list):
                yield own, k, 0, v, None
            else:
                yield "list" if isinstance(v, list) else "object" if isinstance(v, dict) else "value", k, 0, v, own


def label(root, kinds: frozenset[str] | None = None) -> list[tuple]:
    """``(pre, post, kind, node, pos, value)`` of every node of a payload in the order of ``pre``.

    With ``kinds`` all nodes are numbered but only rows of those kinds returned.
    """
    rows: list[list] = []
    clock = n_beats = 0
    stack: list = [("payload", None, 0, root, None)]
    while stack:
        top = stack.pop()
        if isinstance(top, list):
            top[1] = clock
            clock += 1
            continue
        kind, node, pos, value, members = top
        if kind == "beat":
            node, pos, n_beats = None, n_beats, n_beats + 1
        row = [clock, -1, kind, node, pos, None]
        if kinds is None or kind in kinds:
            row[5] = _shown(kind, value)
            rows.append(row)
        clock += 1
        if isinstance(value, (dict, list)):
            stack.append(row)
            stack.extend(reversed(list(_members(kind, node, value, members))))
        else:
            row[1] = clock
            clock += 1
    return [tuple(r) for r in rows]


def containing(pre: np.ndarray, post: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """For each interval the place of the one among ``outer`` (places in the order of ``pre``) that contains it, or -1."""
    if not len(outer):
        return np.full(len(pre), -1, np.int64)
    at = np.searchsorted(pre[outer], pre) - 1
    held = outer[np.maximum(at, 0)]
    return np.where((at >= 0) & (post[held] > post), held, -1)


def _batch(raw_ids: list, copies: list, texts: list, kinds: frozenset[str] | None) -> pa.RecordBatch:
    """The linked node rows of some payloads."""
    walked = None if kinds is None else kinds | set(LINKED)
    owner, rows, shift, begun = [], [], [], 0
    for i, text in enumerate(texts):
        if (root := parse_payload(text)) is not None:
            found = label(root, walked)
            rows += found
            owner += [i] * len(found)
            shift += [begun] * len(found)
            begun += 1 + max((r[1] for r in found), default=0)
    columns = list(zip(*rows)) if rows else [()] * 6
    pre, post = (np.array(c, np.int64) for c in columns[:2])
    kind, offset = np.array(columns[2], dtype=object), np.array(shift, np.int64)
    pos = np.array(columns[4], np.int64)
    links = []
    for name in LINKED:
        held = containing(pre + offset, post + offset, np.flatnonzero(kind == name))
        links += [pa.array(values[np.maximum(held, 0)] if len(held) else values, mask=held < 0) for values in (pre, pos)]
    field = np.array(columns[3], dtype=object)
    links.append(pa.array(field[np.maximum(held, 0)] if len(held) else field, pa.string(), mask=held < 0))
    keep = np.ones(len(rows), bool) if kinds is None else np.isin(kind.astype(str), list(kinds)) if rows else np.zeros(0, bool)
    at = np.array(owner, np.int64)
    arrays = [pa.array(raw_ids, pa.int64()).take(pa.array(at)), pa.array(copies, pa.int64()).take(pa.array(at)), pa.array(pre), pa.array(post)]
    arrays += [pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.array(pos), pa.array(columns[5], pa.string()), *links]
    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep))


def nodes(payloads: DataFrame, key: str = "raw_id", payload: str = "payload", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The labelled nodes of every complete payload with the beat and the visual that contain them.

    Every node is numbered; ``kinds`` leaves rows of other kinds where they were read.
    """
    wanted = None if kinds is None else frozenset(kinds)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield _batch(*(part.column(i).to_pylist() for i in range(3)), wanted)

    rows = payloads.select(F.col(f"`{key}`").cast("bigint").alias("raw_id"), F.col(f"`{payload}`").alias("payload")).where("raw_id is not null and payload is not null")
    return rows.select("raw_id", F.monotonically_increasing_id().alias("copy"), "payload").mapInArrow(walk, NODE_SCHEMA)


def beat_objects(payloads: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """``raw_id, beat_pos, beat``: each beat of every complete payload as a JSON text of its own."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                parsed = ((i, parse_payload(text)) for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                rows = [(i, b, json.dumps(beat, ensure_ascii=False)) for i, root in parsed if root is not None for b, beat in enumerate(beats_of(root))]
                ids, places, texts = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=["raw_id", "beat_pos", "beat"])

    rows = payloads.select(F.col(f"`{key}`").cast("bigint").alias("raw_id"), F.col(f"`{payload}`").alias("payload")).where("raw_id is not null and payload is not null")
    return rows.mapInArrow(walk, "raw_id bigint, beat_pos bigint, beat string")


def beat_table(node_rows: DataFrame) -> DataFrame:
    """One row for each beat: ``raw_id, copy, beat_pos, beat_id, pre, post``."""
    return node_rows.where("kind = 'beat'").select("raw_id", "copy", F.col("pos").alias("beat_pos"), F.col("value").alias("beat_id"), "pre", "post")


def visual_table(node_rows: DataFrame) -> DataFrame:
    """One row for each visual with its parent beat."""
    return node_rows.where("kind = 'visual'").select("raw_id", "copy", "beat_pos", "node", F.col("pos").alias("node_pos"), F.col("value").alias("media_type"), "pre", "post")


def term_table(node_rows: DataFrame) -> DataFrame:
    """One row for each entity, action and context of a visual with its parents' positions."""
    rows = node_rows.where("kind in ('entity', 'action', 'context') and value is not null")
    return rows.select("raw_id", "copy", "beat_pos", F.col("visual_node").alias("node"), F.col("visual_pos").alias("node_pos"), "kind", F.col("pos").alias("item_pos"), F.col("value").alias("item_value"))


def item_table(node_rows: DataFrame) -> DataFrame:
    """One row for each entity and overlay content with its parents' positions."""
    items = node_rows.where("value is not null and (kind = 'entity' or (kind = 'overlay' and value <> ''))")
    is_entity = F.col("kind") == "entity"
    return items.select(
        "raw_id",
        "beat_pos",
        F.when(is_entity, F.col("visual_node")).otherwise(F.col("node")).alias("node"),
        F.when(is_entity, F.col("visual_pos")).otherwise(F.col("pos")).alias("node_pos"),
        F.when(is_entity, F.col("pos")).otherwise(F.lit(0)).cast("bigint").alias("item_pos"),
        F.col("value").alias("item_value"),
    )
