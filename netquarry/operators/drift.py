"""Schemas that drift between files (problem 7).

Every file has a schema tree: its fields, with their kinds and nested fields.
The edit script of least cost (schema_tree) between the trees of consecutive
files of a feed names each change. The script from a file's tree to the canonical
columns is compiled into the projection of that file: a kept or renamed field is
read by its key, a moved one by its path, a removed one goes to the extras.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from datetime import UTC, datetime
from ipaddress import IPv4Address

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.operators.schema_tree import LIST, NUMBER, OBJECT, SEP, TEXT, TRUTH, Node, edit_script, identity_only, tree

#: A file's numeric starts are milliseconds if their exact median is above this.
MS_ABOVE = 1e12
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_ISO = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d", re.ASCII)
_DIGITS = re.compile(r"\d{1,10}", re.ASCII)
#: The canonical columns and their types.
CANONICAL = {
    "src_ip": "string", "dst_ip": "string", "ts_start": "double", "protocol": "string", "src_port": "long", "dst_port": "long", "bytes_in": "double", "bytes_out": "double",
    "pkts_in": "double", "pkts_out": "double", "tcp_flags": "string", "flow_duration_ms": "double", "sampling_rate": "long",
}


def kind_of(value: object) -> int:
    if value is None:
        return 0
    if isinstance(value, bool):
        return TRUTH
    if isinstance(value, (int, float)):
        return NUMBER
    return TEXT if isinstance(value, str) else OBJECT if isinstance(value, dict) else LIST


def parse_object(payload: str | None) -> dict | None:
    """The JSON object in a payload; null for anything else."""
    if not payload:
        return None
    try:
        found = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _walk(value: dict, out: dict[str, int]) -> None:
    """Adds the paths and kinds of an object's fields, nested ones to any depth."""
    todo = [("", value)]
    while todo:
        prefix, node = todo.pop()
        for k, v in node.items():
            path = prefix + k.lower()
            out[path] = out.get(path, 0) | kind_of(v)
            if isinstance(v, dict):
                todo.append((path + SEP, v))


_FIELD = "file_id long, path string, kinds int, above long, below long, low double, high double"


def _field_rows(batches: Iterator[pa.RecordBatch], starts: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """The fields of each file in a batch, and for those named in `starts` how their numbers lie about MS_ABOVE."""
    types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    for b in batches:
        seen: dict[int, dict[str, int]] = {}
        numbers: dict[tuple[int, str], list[float]] = {}
        for file, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = parse_object(payload)
            if found and file is not None:
                _walk(found, seen.setdefault(file, {}))
                for k, v in found.items() if starts else ():
                    if (key := k.lower()) in starts and (x := _number(v)) is not None:
                        numbers.setdefault((file, key), []).append(x)
        rows = []
        for file, fields in seen.items():
            for path, kinds in fields.items():
                values = numbers.get((file, path), ())
                high, low = [x for x in values if x > MS_ABOVE], [x for x in values if x <= MS_ABOVE]
                rows.append((file, path, kinds, len(high), len(low), max(low, default=None), min(high, default=None)))
        cols = zip(*rows) if rows else ((),) * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in _FIELD.split(", ")])


def file_fields(raw_records: DataFrame, starts: frozenset[str] = frozenset()) -> DataFrame:
    """Rows (file_id, path, kinds, ms): each field of a file's payloads, nested ones under their parents, with the bits of its non-null kinds.

    ms tells, for the keys in `starts` (lower case), whether their numbers in the
    file have an exact median above MS_ABOVE: counts on both sides of the bound and
    the values beside it decide, so nothing is ordered. Numbers written as text
    count as well.
    """
    seen = raw_records.select(F.col("file_id").cast("long"), F.col("payload").cast("string")).mapInArrow(lambda it: _field_rows(it, starts), _FIELD)
    met = seen.groupBy("file_id", "path").agg(F.bit_or("kinds").alias("kinds"), *[F.sum(c).alias(c) for c in ("above", "below")], F.max("low").alias("low"), F.min("high").alias("high"))
    ms = F.expr(f"coalesce(above > below or above = below and above > 0 and (low + high) / 2 > {MS_ABOVE}, false)")
    return met.select("file_id", "path", "kinds", ms.alias("ms"))


def alias_map(column_aliases: DataFrame) -> dict[str, tuple[str, int]]:
    """alias in lower case -> (canonical name, least rank). The configuration's size is checked before it goes to the driver."""
    rows = column_aliases.select("canonical_name", "alias_name", "alias_rank").where("canonical_name is not null and alias_name is not null").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100 000 aliases")
    out: dict[str, tuple[str, int]] = {}
    for r in rows:
        rank = r.alias_rank if r.alias_rank is not None else 1 << 30
        key = r.alias_name.lower()
        if key not in out or (rank, r.canonical_name) < (out[key][1], out[key][0]):
            out[key] = (r.canonical_name, rank)
    return out


def _listed(edits: list) -> list[tuple[str, str]]:
    """(field, change) of edits. The end of a move or of a relabelling that is a field of the payload itself was added or removed there; deeper down it is moved or renamed."""
    out = set()
    for e in edits:
        if e.kind in ("moved", "relabelled"):
            deep = "moved" if e.kind == "moved" else "renamed"
            out.add((e.path, deep if SEP in e.path else "added"))
            out.add((e.source, deep if SEP in e.source else "removed"))
        else:
            out.add((e.path, e.kind))
    return sorted(out)


def _diff(batches: Iterator[pa.RecordBatch], aliases: dict[str, tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))  # as deep as the parser allows
    known: dict[tuple, tuple[float, list[tuple[str, str]]]] = {}
    for b in batches:
        rows = []
        for file, now, before in zip(*(b.column(i).to_pylist() for i in range(3))):
            key = tuple(tuple(sorted((f["path"], f["kinds"]) for f in side or [])) for side in (before, now))
            if key[0] == key[1]:
                continue
            if key not in known:
                if len(known) > 20_000:
                    known.clear()
                cost, edits = edit_script(tree(list(key[0]), aliases), tree(list(key[1]), aliases))
                known[key] = cost, _listed(edits)
            cost, edits = known[key]
            rows += [(file, path.replace(SEP, "."), kind, SEP not in path, cost) for path, kind in edits]
        cols = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.float64()))], ["file_id", "field_name", "change_kind", "top", "script_cost"])


def previous(files: DataFrame, key: str, order: str, value: str, width: int = 256) -> DataFrame:
    """files with the value of the row before in its key as `before` (null for the first) and whether there is one.

    Two levels: within blocks of `width` consecutive orders, then between blocks by
    the last row of each. No task gets more than a block of a key's rows.
    """
    block = F.expr(f"{order} div {width}")
    rows = files.withColumn("_block", block)
    inside = Window.partitionBy(key, "_block").orderBy(order)
    boxed = F.struct(F.col(value).alias("v"))
    rows = rows.withColumn("_lag", F.lag(boxed).over(inside))
    last = rows.groupBy(key, "_block").agg(F.max_by(boxed, order).alias("_last"))
    carry = last.select(key, "_block", F.lag("_last").over(Window.partitionBy(key).orderBy("_block")).alias("_carry"))
    found = F.coalesce("_lag", "_carry")
    return rows.join(carry, [key, "_block"], "left").select(*files.columns, found.isNotNull().alias("has_before"), found["v"].alias("before"))


def file_schemas(raw_files: DataFrame, raw_records: DataFrame) -> DataFrame:
    """(file_id, feed_id, file_seq, fields): one row a file, those without any field included."""
    fields = file_fields(raw_records).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("path", "kinds"))).alias("fields"))
    listed = raw_files.where("file_id is not null").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.min("feed_id").alias("feed_id"), F.min("file_seq").alias("file_seq"))
    return listed.join(fields, "file_id", "left")


def changes(raw_files: DataFrame, raw_records: DataFrame, column_aliases: DataFrame) -> DataFrame:
    """Edits (file_id, field_name, change_kind, top, script_cost) of each file against the one before it in its feed.

    Kinds of change: added, removed, renamed, retyped, and moved for nested fields;
    `top` marks fields of the payload itself. Payloads that are not JSON objects
    have no fields; a feed's first file and files without feed or file_seq have no
    edits; a field always null has no kind and is never retyped.
    """
    aliases = alias_map(column_aliases)
    files = file_schemas(raw_files, raw_records).where("feed_id is not null and file_seq is not null")
    pairs = previous(files, "feed_id", "file_seq", "fields").where("has_before").select("file_id", "fields", "before")
    return pairs.mapInArrow(lambda it: _diff(it, aliases), "file_id long, field_name string, change_kind string, top boolean, script_cost double")


def canonical_tree() -> Node:
    """The schema that every file is projected onto."""
    kind = lambda t: TEXT if t == "string" else NUMBER
    return Node("", OBJECT, 0, {c: Node(c, kind(t)) for c, t in CANONICAL.items()})


def projection(fields: list[tuple[str, int]], aliases: dict[str, tuple[str, int]]) -> dict[str, str]:
    """Path of keys in lower case -> canonical column, compiled from the edit script that turns a file's tree into the canonical one.

    A canonical column that the script neither adds nor moves is a field of the
    file, under the key it has there; a moved one is read at its source, a nested
    field whose key is among the column's names.
    """
    file = tree(fields, aliases, deep=True)
    named = Node("", OBJECT, 0, {n: c for n, c in file.children.items() if n not in CANONICAL or c.label in aliases})  # a key counts by the configured names only
    _, edits = edit_script(named, canonical_tree(), identity_only)
    added = {e.path for e in edits if e.kind == "added"}
    moved = {e.path: e.source for e in edits if e.kind in ("moved", "relabelled")}
    out = {named.children[c].label: c for c in CANONICAL if c not in added and c not in moved}
    for column, source in moved.items():
        node, keys = named, []
        for name in source.split(SEP):
            node = node.children[name]
            keys.append(node.label)
        if keys[-1] in aliases:
            out[SEP.join(keys)] = column
    return out


def _compile(batches: Iterator[pa.RecordBatch], aliases: dict[str, tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """The projection as JSON: path -> [canonical column, what its numbers are divided by]. Files with the same fields share it."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))
    known: dict[tuple, dict[str, str]] = {}
    for b in batches:
        made = []
        for fields in b.column(1).to_pylist():
            key = tuple((f["path"], f["kinds"]) for f in fields)
            if key not in known:
                if len(known) > 20_000:
                    known.clear()
                known[key] = projection(list(key), aliases)
            ms = {f["path"] for f in fields if f["ms"]}
            made.append(json.dumps({k: [c, 1000 if c == "ts_start" and k in ms else 1] for k, c in known[key].items()}, sort_keys=True))
        yield pa.RecordBatch.from_pydict({"file_id": b.column(0), "compiled": pa.array(made, pa.string())})


def _number(value: object) -> float | None:
    """A number, or a text of one; null for anything else."""
    if value is None or isinstance(value, (bool, dict, list)):
        return None
    try:
        number = float(value)
    except (ValueError, OverflowError):
        return None
    return number if abs(number) <= 9e18 else None


def _start(value: object, divisor: int) -> float | None:
    """Epoch seconds of a number in the file's unit or of an ISO text with time of day, UTC where it names no offset."""
    number = _number(value)
    if number is not None:
        return number / divisor
    if not isinstance(value, str) or not _ISO.match(value.strip()):
        return None
    try:
        at = datetime.fromisoformat(value.strip())
        return ((at if at.tzinfo else at.replace(tzinfo=UTC)) - EPOCH).total_seconds()
    except (ValueError, OverflowError):
        return None


def _address(value: object) -> str:
    """An address as text; a whole number of 32 bits, or a text of one, in dotted form."""
    number = value
    if isinstance(value, str) and _DIGITS.fullmatch(value.strip()):
        number = int(value)
    if isinstance(number, float) and number.is_integer():
        number = int(number)
    if isinstance(number, int) and not isinstance(number, bool) and 0 <= number < 1 << 32:
        return str(IPv4Address(number))
    return value if isinstance(value, str) else json.dumps(value)


def _coerced(value: object, column: str, divisor: int = 1):
    """value as the canonical column's type; null where it has no such form."""
    kind = CANONICAL[column]
    if value is None:
        return None
    if column == "ts_start":
        return _start(value, divisor)
    if column in ("src_ip", "dst_ip"):
        return _address(value)
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value)
    try:
        number = float(value) if not isinstance(value, (dict, list)) else None
    except (TypeError, ValueError, OverflowError):
        return None
    if number is None or number != number or abs(number) > 9e18:
        return None
    return round(number) if kind == "long" else number


def _nested(value: dict, prefix: str, to: dict[str, list], row: dict) -> None:
    """Columns that a projection reads inside an object; the object itself stays among the extras."""
    todo = [(prefix, value)] if any(path.startswith(prefix) for path in to) else []
    while todo:
        at, node = todo.pop()
        for k, v in node.items():
            path = at + k.lower()
            if path in to:
                row[to[path][0]] = _coerced(v, *to[path])
            elif isinstance(v, dict):
                todo.append((path + SEP, v))


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, dict[str, list]] = {None: {}}
    types = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    for b in batches:
        ids, cols, rest = ([], [], []), {c: [] for c in CANONICAL}, []
        for record, file, line, payload, compiled in zip(*(b.column(i).to_pylist() for i in range(5))):
            found = parse_object(payload)
            if found is None:
                continue
            if compiled not in known:
                if len(known) > 20_000:
                    known.clear()
                known[compiled] = json.loads(compiled) if compiled else {}
            to, row, extra = known[compiled], {}, []
            for k, v in found.items():
                key = k.lower()
                name, divisor = to.get(key, (None, 1))
                if name is None:
                    extra.append((key, None if v is None else v if isinstance(v, str) else json.dumps(v)))
                    if isinstance(v, dict):
                        _nested(v, key + SEP, to, row)
                    continue
                row[name] = _coerced(v, name, divisor)
                if row[name] is None and v is not None:
                    extra.append((key, v if isinstance(v, str) else json.dumps(v)))
            for x, v in zip(ids, (record, file, line)):
                x.append(v)
            for c in CANONICAL:
                cols[c].append(row.get(c))
            rest.append(list(dict(extra).items()))
        arrays = [*(pa.array(x, pa.int64()) for x in ids), *(pa.array(cols[c], types[t]) for c, t in CANONICAL.items()), pa.array(rest, pa.map_(pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, ["record_id", "file_id", "line_no", *CANONICAL, "extras"])


def unified(raw_files: DataFrame, raw_records: DataFrame, column_aliases: DataFrame) -> DataFrame:
    """Every payload that is a JSON object as a row of the canonical columns; other fields, and values the column's type cannot hold, as text in `extras`.

    Repeated lines stay repeated. Each file has the projection compiled from its
    edit script, so one key can be a canonical column in one file and an extra in
    another. A column that no field of the payload itself gives is taken from a
    nested field under one of its names; the object stays in `extras` as well.
    ts_start is in epoch seconds: ISO texts are read, and a file whose numbers have
    a median above MS_ABOVE wrote milliseconds. The key's name does not tell the
    unit: files hold seconds under FLOW_START_MILLISECONDS. Whole numbers in the
    address columns are IPv4 addresses and come out dotted.
    """
    aliases = alias_map(column_aliases)
    starts = frozenset(k for k, (c, _) in aliases.items() if c == "ts_start")
    fields = file_fields(raw_records, starts).where("file_id is not null").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("path", "kinds", "ms"))).alias("fields"))
    rows = raw_records.select(F.col("record_id").cast("long"), F.col("file_id").cast("long"), F.col("line_no").cast("long"), F.col("payload").cast("string"))
    compiled = fields.mapInArrow(lambda it: _compile(it, aliases), "file_id long, compiled string")
    joined = rows.join(compiled, "file_id", "left").select("record_id", "file_id", "line_no", "payload", "compiled")
    schema = "record_id long, file_id long, line_no long, " + ", ".join(f"{c} {t}" for c, t in CANONICAL.items()) + ", extras map<string,string>"
    return joined.mapInArrow(_project, schema)
