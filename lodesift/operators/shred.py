"""Deeply nested records as related flat tables.

``adjacency`` turns each JSON document into one table of nodes: node, parent, owner, label, ordinal and
scalar. ``entities`` joins the object nodes with their scalar children and pivots these
into columns (``entity``, for one place, and ``roots``, for the records themselves) or a map; ``record_id`` and ``node`` are the key,
``record_id`` and ``owner`` the link to the parent table.

Reading JSON of changing shapes of any depth, with parts sent as text inside text, is the one step
the built-in readers don't express; it is one pass over Arrow batches without a shuffle. Everything
after it are DataFrame operations. Columns that are nested already are taken apart without JSON (``column_parts``).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.session import ship, spread

ADJACENCY = "record_id long, node int, parent int, owner int, label string, place string, field string, ordinal int, owner_ordinal int, entity boolean, kind string, scalar string"

#: Places whose nodes become rows of their own, with the way they are held:
#: list (a lone element counts as a list of one), map (each entry), maplist (each element of each entry), one.
PLACES = {
    "findings": "list",
    "findings.tags": "list",
    "findings.flow.steps": "list",
    "suppressed_rules": "list",
    "calls": "list",
    "called_by": "list",
    "taint_sig": "one",
    "taint_sig.sink_calls": "list",
    "taint_sig.suppressed_sinks": "list",
    "taint_sig.sanitized_paths": "list",
    "taint_sig.tainted_params": "maplist",
    "taint_sig.source_params": "map",
    "tool_input": "one",
    "tool_input.edits": "list",
    "tool_response": "one",
}
#: Levels to which a node's path is spelt out; deeper ones are reached by ``parent`` and ``label``.
SPELT = 64
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_BLANK = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def snake(key: str) -> str:
    """A field's name in the naming used here: ``sinkCalls``, ``SinkCalls`` and ``sink-calls`` are ``sink_calls``."""
    return re.sub(r"[\s\-_]+", "_", _HUMP.sub("_", key.strip())).lower()


class _Unreadable(Exception):
    pass


class _Digits(str):
    """A number that is kept as it is written."""


class _Repeating(dict):
    """An object with repeated names: the last of each counts, ``others`` has the rest."""

    others: list[tuple[str, object]]


def _object(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) == len(pairs):
        return out
    kept = _Repeating(out)
    last = {k: i for i, (k, _) in enumerate(pairs)}
    kept.others = [p for i, p in enumerate(pairs) if last[p[0]] != i]
    return kept


def _whole(s: str) -> object:
    return int(s) if len(s) < 4000 else _Digits(s)


def _broken(s: str) -> object:
    x = float(s)
    return x if math.isfinite(x) else _Digits(s)


def _constant(name: str) -> object:
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_int=_whole, parse_float=_broken)
_STRICT = json.JSONDecoder(object_pairs_hook=_object, parse_int=_whole, parse_float=_broken, parse_constant=_constant)


def _read_deep(s: str, constants: bool) -> object:
    """Reads JSON of any depth, without recursion; raises ``ValueError`` as the library does."""
    stack: list[tuple[str, list, str | None]] = []
    at, n = _BLANK.match(s, 0).end(), len(s)  # type: ignore[union-attr]

    def blanks(i: int) -> int:
        return _BLANK.match(s, i).end()  # type: ignore[union-attr]

    def key(i: int) -> tuple[str, int]:
        if s[i : i + 1] != '"':
            raise ValueError(i)
        k, i = scanstring(s, i + 1, True)
        i = blanks(i)
        if s[i : i + 1] != ":":
            raise ValueError(i)
        return k, blanks(i + 1)

    kind, items, name = "", [], None
    while True:
        c = s[at : at + 1]
        if c == "{" or c == "[":
            stack.append((kind, items, name))
            kind, items, name, at = c, [], None, blanks(at + 1)
            if s[at : at + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    name, at = key(at)
                continue
            value: object = {} if c == "{" else []
            kind, items, name = stack.pop()
            at += 1
        elif c == '"':
            value, at = scanstring(s, at + 1, True)
        else:
            m = _NUMBER.match(s, at)
            if m:
                value, at = (_whole(m.group()) if m.group(2) is None and m.group(3) is None else _broken(m.group())), m.end()
            else:
                word = next((w for w in _WORDS if s.startswith(w, at)), None)
                if word is None or (not constants and word[-1] in "Ny"):
                    raise ValueError(at)
                value, at = _WORDS[word], at + len(word)
        while True:  # the value is whole: it goes to what encloses it, which may thereby be whole
            at = blanks(at)
            if not kind:
                if at != n:
                    raise ValueError(at)
                return value
            items.append((name, value) if kind == "{" else value)
            c = s[at : at + 1]
            at += 1
            if c == ",":
                at = blanks(at)
                if kind == "{":
                    name, at = key(at)
                break
            if c != ("}" if kind == "{" else "]"):
                raise ValueError(at)
            value = _object(items) if kind == "{" else items
            kind, items, name = stack.pop()


def read(s: str, constants: bool = True) -> object:
    """The value of a JSON text of any depth; raises ``ValueError`` if it is none. ``constants``: NaN and infinities are numbers."""
    try:
        return (_DECODER if constants else _STRICT).decode(s)
    except RecursionError:
        return _read_deep(s, constants)


def _parsed(text: str, outer: bool) -> object:
    """A text that holds JSON of an object or a list, or a text of these, however often it is wrapped; else the text itself (``outer``: unreadable)."""
    value: object = text
    while isinstance(value, str) and not isinstance(value, _Digits):
        s = value.strip().lstrip("﻿")
        try:
            if s[:1] not in ("{", "[", '"'):
                raise ValueError(s[:1])
            value = read(s)
        except ValueError:
            if outer:
                raise _Unreadable from None
            return text
    return value


def _nodes(payload: str | None, places: dict[str, str], inner: frozenset[str]) -> Iterator[tuple]:
    """The nodes of one payload: (node, parent, owner, label, place, field, ordinal, owner_ordinal, entity, kind, scalar)."""
    if payload is None or not payload.strip():
        return
    try:
        value = _parsed(payload, True)
    except _Unreadable:
        return
    if not isinstance(value, dict):
        return
    out: list[tuple] = []
    fields: set[tuple[int | None, str]] = set()
    ordinals: list[int | None] = []

    def add(parent: int | None, owner: int | None, label: str, place: str, field: str, ordinal: int | None, entity: bool, v: object) -> int:
        node = len(out)
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "scalar"
        scalar = (None if v else "{}" if kind == "object" else "[]") if kind in ("object", "array") else None if v is None else str(v) if isinstance(v, str) else json.dumps(v)
        if not entity and scalar is not None:
            if (owner, field) in fields:
                field = f"{field}~{node}"
            fields.add((owner, field))
        out.append((node, parent, owner, label, place, field, ordinal, None if owner is None else ordinals[owner], entity, kind, scalar))
        ordinals.append(ordinal)
        return node

    def push(v: object, place: str, field: str, node: int, owner: int, depth: int) -> None:
        """Puts the children of ``v`` on the stack, the first on top."""
        if isinstance(v, dict):
            members = [(k, snake(k), x) for k, x in v.items()]
            if isinstance(v, _Repeating):
                members += [(k, snake(k) + "~", x) for k, x in v.others]
            for k, name, x in reversed(members):
                stack.append((x, name, joined(place, name, depth), joined(field, name, depth), None, node, owner, False, depth + 1))
        elif isinstance(v, list):
            for i in range(len(v) - 1, -1, -1):
                stack.append((v[i], "", joined(place, "[]", depth), joined(field, f"[{i}]", depth), i, node, owner, False, depth + 1))

    def joined(path: str, name: str, depth: int) -> str:
        if depth >= SPELT:
            return path if path.endswith("…") else path + "…"
        return path + name if name[:1] == "[" else f"{path}.{name}" if path else name

    # (value, label, place, field, ordinal, parent, owner, an element of a list or map of entities, depth)
    stack: list[tuple] = []
    push(value, "", "", add(None, None, "", "", "", None, True, value), 0, 0)
    while stack:
        v, label, place, field, ordinal, parent, owner, element, depth = stack.pop()
        if isinstance(v, str) and place in inner:
            v = _parsed(v, False)
        how = places.get(place)
        if how == "one" and v is not None:
            node = add(parent, owner, label, place, "", ordinal, True, v)
            push(v, place, "", node, node, 0)
        elif element and v is not None:
            node = add(parent, owner, label, place, "", ordinal, True, v)
            push(v, place, "", node, node, 0)
        elif how and not element and v is not None:
            node = add(parent, owner, label, place, field, ordinal, False, v if isinstance(v, (dict, list)) else [v])
            if how == "list":
                items = v if isinstance(v, list) else [v]
                entries = [(x, label, i) for i, x in enumerate(items)]
            elif isinstance(v, dict) and how == "map":
                entries = [(x, k, None) for k, x in v.items()]
            elif isinstance(v, dict):
                entries = [(y, k, i) for k, x in v.items() if x is not None for i, y in enumerate(x if isinstance(x, list) else [x])]
            else:
                entries = []
                push(v if isinstance(v, list) else [v], place, field, node, owner, depth)
            for x, k, i in reversed(entries):
                stack.append((x, k, place, field, i, node, owner, True, depth))
            if isinstance(v, _Repeating):
                for k, x in v.others:
                    stack.append((x, k + "~", joined(place, k + "~", depth), joined(field, k + "~", depth), None, node, owner, False, depth + 1))
        else:
            node = add(parent, owner, label, place, field, ordinal, False, v)
            push(v, place, field, node, owner, depth)
    yield from out


def _inner(places: dict[str, str]) -> frozenset[str]:
    """Places, and what lies between them, where a text may stand for a part sent as text."""
    return frozenset(".".join(p.split(".")[: i + 1]) for p in places for i in range(len(p.split("."))))


def _strings(values: list) -> pa.Array:
    """Texts as an array; half of a surrogate pair, which JSON can write but no text can hold, becomes U+FFFD."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") for v in values], pa.string())


def adjacency(df: DataFrame, record_id: str, payload: str, places: dict[str, str] | None = None) -> DataFrame:
    """The nodes of every record's JSON ``payload`` (schema ``ADJACENCY``), numbered from 0 (the record itself) in document order.

    ``entity`` marks the record and the nodes of ``places``; ``owner`` is the nearest enclosing entity node and ``owner_ordinal`` its place in its
    list; ``place`` is the path of field names from the record and ``field`` that from the owner, with positions in lists, unique among an
    owner's scalars (a further one of a name has ``~`` and its node's number behind). Field names are compared in snake case, whatever the
    producer's naming; of a name that an object repeats, the last counts, and the others are kept under the name with ``~``.
    Paths of more than ``SPELT`` levels end in ``…``; ``parent`` and ``label`` lead through any depth.

    Null, blank, cut or otherwise unreadable payloads and payloads that aren't objects give no node; texts may be wrapped as texts
    any number of times; numbers of any length are kept; null members give a node of kind ``null``, never an entity; empty objects and lists have
    ``{}`` and ``[]`` as scalar. Repeated rows are shredded each; extra columns are ignored.
    """
    ship(df.sparkSession)
    held = places or PLACES
    inner = _inner(held)
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), None, None, None, pa.int32(), pa.int32(), pa.bool_(), None, None]
    names = [c.split()[0] for c in ADJACENCY.split(", ")]

    def shred(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([_strings(list(c)) if t is None else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in _nodes(text, held, inner):
                    rows.append((rid, *row))
                    if len(rows) >= 20_000:
                        yield arrays(rows)
                        rows = []
            yield arrays(rows)

    return spread(df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(payload).alias("payload"))).mapInArrow(shred, ADJACENCY)


def _position(places: dict[str, str]) -> Column:
    """The list positions and map keys that lead to an entity, from the outside in."""
    own = {"list": F.col("ordinal").cast("string"), "map": F.col("label"), "maplist": F.concat_ws("/", "label", "ordinal"), "one": F.lit("0")}
    mine = F.coalesce(*[F.when(F.col("place").isin([p for p, h in places.items() if h == how]), c) for how, c in own.items()])
    # a list of entities lends its position to the entities within
    lent = [p for p in places if any(p.startswith(q + ".") and h == "list" for q, h in places.items())]
    return F.when(F.col("place").isin(lent), F.concat_ws("/", "owner_ordinal", mine)).otherwise(mine)


def _joined(nodes: DataFrame, pivoted: dict[str, Column], places: dict[str, str] | None) -> DataFrame:
    """Entity nodes joined with their scalar children, and these aggregated to ``pivoted``.

    A child carries its owner's number, so both are one aggregation on (record, entity): a hash exchange without a self-join.
    """
    own = F.struct("owner", "place", "ordinal", F.col("label").alias("map_key"), _position(places or PLACES).alias("pos_path"), F.when(F.col("kind") == "scalar", F.col("scalar")).alias("value"))
    rows = nodes.where(F.col("entity") | F.col("scalar").isNotNull()).select(
        "record_id",
        F.when(F.col("entity"), F.col("node")).otherwise(F.col("owner")).alias("node"),
        F.when(F.col("entity"), own).alias("own"),
        F.when(~F.col("entity"), F.col("field")).alias("field"),
        "scalar",
    )
    return rows.groupBy("record_id", "node").agg(F.first("own", ignorenulls=True).alias("own"), *[c.alias(n) for n, c in pivoted.items()]).where(F.col("own").isNotNull())


def _rest(listed: Sequence[str]) -> Column:
    """A map of the scalars that have no column."""
    other = F.col("field").isNotNull() & ~F.col("field").isin(list(listed)) if listed else F.col("field").isNotNull()
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(other, F.struct("field", "scalar")))))


def _columns(fields: Sequence[str]) -> dict[str, Column]:
    return {f.replace(".", "_"): F.max(F.when(F.col("field") == f, F.col("scalar"))) for f in fields} | {"rest": _rest(fields)}


def entities(nodes: DataFrame, places: dict[str, str] | None = None) -> DataFrame:
    """``record_id, child_path, pos_path, node, owner, value, fields`` of all entities but the records themselves.

    ``fields`` maps the names of an entity's scalars to their texts; ``value`` is set where the part itself is a scalar.
    """
    return _joined(nodes, {"fields": _rest(())}, places).where(F.col("own.place") != "").select("record_id", F.col("own.place").alias("child_path"), "own.pos_path", "node", "own.owner", "own.value", "fields")


def entity(nodes: DataFrame, place: str, fields: Sequence[str], places: dict[str, str] | None = None) -> DataFrame:
    """The flat table of one place: ``record_id, node, owner, ordinal, map_key, pos_path, value``, the scalar ``fields`` of its objects and ``rest``.

    ``value`` is set where the part itself is a scalar. A field is found in the object itself or in objects below it that are no entity
    (``flow.scope``). ``rest`` maps all scalars that have no column, so none is lost. Of a repeated field the first counts; the others are in ``rest``.
    """
    mine = F.when(F.col("entity"), F.col("place") == place).otherwise(F.col("place").startswith(place))
    got = _joined(nodes.where(mine), _columns(fields), places)
    return got.select("record_id", "node", "own.owner", "own.ordinal", "own.map_key", "own.pos_path", "own.value", *_columns(fields))


def roots(nodes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The flat table of the records themselves, to whose ``node`` (0) the ``owner`` of the outermost entities leads: ``record_id, node``, their scalar ``fields`` and ``rest``."""
    got = _joined(nodes.where(F.when(F.col("entity"), F.col("node") == 0).otherwise(F.col("owner") == 0)), _columns(fields), None)
    return got.select("record_id", "node", *_columns(fields))


def column_parts(df: DataFrame, record_id: str, parts: dict[str, tuple[str, str]]) -> DataFrame:
    """``record_id, child_path, pos_path`` of the entities of columns that are nested already, in one pass without a shuffle.

    ``parts``: by place the column and how it is held (as in ``PLACES``). Null parts and elements give no row, but keep their position.
    """
    text = "string"

    def rows(place: str, column: str, how: str) -> Column:
        c, name = F.col(column), F.lit(place).alias("child_path")
        if how == "one":
            return F.when(c.isNotNull(), F.array(F.struct(name, F.lit("0").alias("pos_path"))))
        if how == "list":
            got = F.transform(c, lambda x, i: F.when(x.isNotNull(), F.struct(name, i.cast(text).alias("pos_path"))))
        elif how == "map":
            got = F.transform(F.map_entries(c), lambda e: F.when(e["value"].isNotNull(), F.struct(name, e["key"].cast(text).alias("pos_path"))))
        else:
            got = F.flatten(F.transform(F.filter(F.map_entries(c), lambda e: e["value"].isNotNull()), lambda e: F.transform(e["value"], lambda x, i: F.when(x.isNotNull(), F.struct(name, F.concat_ws("/", e["key"].cast(text), i.cast(text)).alias("pos_path"))))))
        return F.filter(got, lambda x: x.isNotNull())

    none = F.array().cast("array<struct<child_path:string,pos_path:string>>")
    every = F.concat(*[F.coalesce(rows(p, c, how).cast("array<struct<child_path:string,pos_path:string>>"), none) for p, (c, how) in parts.items()])
    return df.select(F.col(record_id).alias("record_id"), F.explode(every).alias("x")).select("record_id", "x.*")
