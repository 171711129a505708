"""Files whose schemas drift: one consistent table, and a list of every change.

``headers`` reads each file's schema in parallel, once; ``fold_schema`` folds all of them
through the type lattice; ``unified`` casts every file's records to the union schema;
``differences`` compares each file with the readable one before it in its series. The last three
take the headers of one reading.

A field is a leaf inside a record (``mesh.face_count``, an inner object adds a step, an
array is one leaf). A file has a field if an object holds a non-null value for it.

Defined results: a null or unreadable payload (empty, cut short, no JSON object) gives
no header and is skipped as a predecessor; stray characters before the first brace and
after the end of the JSON are ignored; objects without an id count for schemas but not for
the recognition of renames; of objects that share an id the last one counts there. Rows
with a null series key form a series. Null times come first. In the log, of rows that repeat a file
id the earliest exported counts; in the one table each row counts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tesserae.operators.ordered import with_previous
from tesserae.session import Scratch

#: ``signature``: each field with its types, in order. ``sizes`` and ``vals``: a field's, in the same order; its values are those of the objects that
#: hold a record, a letter for the JSON type before each text. ``ids``, ``places`` and ``held``: of these objects, with the records they hold as bits.
#: Lists are texts, which take a fraction of an array's place.
HEADER = "signature string, sizes array<int>, vals array<string>, ids string, places array<int>, held array<int>"
#: What stands between the fields of a signature, the parts of a field and the elements of a list; and what such letters become within them.
FIELD, PART, ITEM = "\x1d", "\x1e", "\x1f"
ESCAPES = {"\x1b": "\x1bb", FIELD: "\x1bf", PART: "\x1bp", ITEM: "\x1bi"}

#: JSON types by the letter they are marked with.
TYPES = {"i": "integer", "d": "double", "b": "boolean", "s": "string", "a": "array"}
#: Integers up to which a double holds each.
EXACT = 1 << 53
#: Texts of values longer than this are compared by their digest.
LONG = 40

#: The lattice: each pair of types has one least type that holds both. Integers that a double holds exactly are ``integer``, those of
#: 64 bits ``long``, those of 38 digits ``decimal``. Everything fits a string.
PROMOTION = {
    frozenset({"integer", "double"}): "double",
    frozenset({"integer", "long"}): "long",
    frozenset({"integer", "decimal"}): "decimal",
    frozenset({"long", "decimal"}): "decimal",
}
SPARK_TYPE = {
    "integer": "bigint", "long": "bigint", "decimal": "decimal(38,0)", "double": "double", "boolean": "boolean", "string": "string", "array": "string", "null": "string",
}
#: What an integer field's greatest value needs, by ``size``.
SIZES = ("integer", "long", "decimal", "string")


def promote(a: str, b: str) -> str:
    """The least common type of two types of the lattice."""
    if a == b or b == "null":
        return a
    return b if a == "null" else PROMOTION.get(frozenset({a, b}), "string")


class _Huge(str):
    """The digits of an integer that is too long for Python to read."""


def _integer(text: str) -> int | _Huge:
    return int(text) if len(text) < 4000 else _Huge(text)


_DECODER = json.JSONDecoder(parse_int=_integer)


def parse(payload: str | None) -> dict | None:
    """The JSON object in a payload, freed of stray characters around it; None if it isn't complete."""
    start = payload.find("{") if payload else -1
    if start < 0:
        return None
    try:
        found, _ = _DECODER.raw_decode(payload, start)
    except (ValueError, RecursionError):
        return None
    return found


_CONTROL = re.compile("[\x1b\x1d-\x1f]")


def _escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPES[m[0]], text) if _CONTROL.search(text) else text


def _marked(value: object, whole: bool) -> str:
    """A value as text, after the letter of its JSON type; without the letters that lists are joined by."""
    kind = type(value)
    if kind is int and -EXACT <= value <= EXACT:
        return f"i{value}"
    if kind is float:
        return f"d{value!r}" if math.isfinite(value) else "d" + json.dumps(value)
    if kind is bool:
        return "btrue" if value else "bfalse"
    if kind is str:
        text = "s" + _escaped(value)
    elif kind is list:
        text = "a" + json.dumps(value, sort_keys=True)
    else:
        text = f"i{value}"
    if whole or len(text) <= LONG:
        return text
    return text[0] + "#" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _size(value: object) -> int:
    """The place in SIZES of what holds an integer."""
    if type(value) is _Huge:
        return 3
    if type(value) is not int or -EXACT <= value <= EXACT:
        return 0
    return 1 if -(1 << 63) <= value < 1 << 63 else 2 if abs(value) < 10**38 else 3


def leaves(value: dict, path: str) -> Iterator[tuple[str, object]]:
    """The non-null leaves of an object, each with its dotted path."""
    for name, inner in value.items():
        if isinstance(inner, dict):
            yield from leaves(inner, f"{path}.{name}")
        elif inner is not None:
            yield f"{path}.{name}", inner


def _objects(payload: dict) -> list[dict]:
    found = payload.get("objects")
    return [o for o in found if isinstance(o, dict)] if isinstance(found, list) else []


def _header(payload: dict, records: Sequence[str], whole: bool) -> tuple:
    """One file's header, in the order of HEADER."""
    columns: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    ids, places, bits = [], [], []
    for pos, item in enumerate(_objects(payload)):
        held, n = 0, len(ids)
        for bit, record in enumerate(records):
            inner = item.get(record)
            if not isinstance(inner, dict):
                continue
            held |= 1 << bit
            for path, value in leaves(inner, record):
                column = columns.get(path)
                if column is None:
                    column = columns[path] = []
                if len(column) < n:
                    column.extend([""] * (n - len(column)))
                column.append(_marked(value, whole))
                if size := _size(value):
                    sizes[path] = max(size, sizes.get(path, 0))
        if held:
            key = item.get("id")
            ids.append("" if key is None else "s" + _escaped(key if isinstance(key, str) else json.dumps(key, sort_keys=True)))
            places.append(pos)
            bits.append(held)
    fields = sorted(columns)
    types = (",".join(sorted(TYPES[x] for x in {v[0] for v in columns[f] if v})) for f in fields)
    signature = FIELD.join(f"{_escaped(f)}{PART}{t}" for f, t in zip(fields, types))
    return signature, [sizes.get(f, 0) for f in fields], [ITEM.join(columns[f]) for f in fields], ITEM.join(ids), places, bits


def headers(
    files: DataFrame, records: Sequence[str], file_id: str = "file_id", series: str = "source_key", at: str = "exported_at", payload: str = "payload", keep: Sequence[str] = (), whole: bool = False
) -> DataFrame:
    """(row, file_id, series, at, kept, and the columns of HEADER) of every readable file: its schema, and the values by which a rename is told
    from a removal. ``kept`` is a struct of the ``keep`` columns. ``whole``: long values as they are, as ``unified`` needs them.

    The one reading of the payloads: written to the shared scratch folder, from where all else is made.
    """
    names = list(records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [parse(p) for p in batch.column("payload").to_pylist()]
            read = [i for i, c in enumerate(contents) if c is not None]
            found = [_header(contents[i], names, whole) for i in read]
            heads = batch.select(["file_id", "series", "at", "kept"]).take(pa.array(read, pa.int64()))
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*heads.columns, *made], [*heads.schema.names, *header.names])

    header = T.StructType.fromDDL(HEADER)
    arrow = [to_arrow_type(f.dataType) for f in header]
    kept = F.struct(*[F.col(f"`{k}`") for k in keep]) if keep else F.struct(F.lit(0).alias("none"))
    read = files.select(F.col(file_id).alias("file_id"), F.col(series).alias("series"), F.col(at).alias("at"), kept.alias("kept"), F.col(payload).alias("payload"))
    head = ", ".join(f"{c} {read.schema[c].dataType.simpleString()}" for c in ("file_id", "series", "at", "kept"))
    parsed = read.mapInArrow(run, f"{head}, {HEADER}")
    return Scratch(files.sparkSession, "schema-drift").save(parsed.select(F.monotonically_increasing_id().alias("row"), "*"))[0]


def compare(before: Mapping[str, str], now: Mapping[str, str], old: Callable[[str], dict], new: Callable[[str], dict]) -> list[tuple[str, str, str | None, str | None, str | None]]:
    """The changes from one header to the next: (field, change, old types, new types, new field).

    ``before`` and ``now`` have each field's types; ``old`` and ``new`` give a field's values by object id.
    """
    out = [(f, "retyped", before[f], now[f], f) for f in before if f in now and before[f] != now[f]]
    gone, come = [f for f in before if f not in now], [f for f in now if f not in before]
    matches = []
    for g in gone:
        near = [c for c in come if g.split(".", 1)[0] == c.split(".", 1)[0]]
        held = old(g) if near else {}
        for c in near:
            both = [held[i] == v for i, v in new(c).items() if i in held]
            if both and 2 * sum(both) > len(both):
                matches.append((-sum(both) / len(both), -sum(both), g, c))
    renamed: dict[str, str] = {}
    for _, _, g, c in sorted(matches):
        if g not in renamed and c not in renamed.values():
            renamed[g] = c
    out += [(g, "renamed", before[g], now[c], c) for g, c in renamed.items()]
    out += [(g, "removed", before[g], None, None) for g in gone if g not in renamed]
    out += [(c, "added", None, now[c], c) for c in come if c not in renamed.values()]
    return sorted(out)


def _types(signature: str) -> dict[str, str]:
    return dict(f.split(PART) for f in signature.split(FIELD)) if signature else {}


def _values(signature: str, vals: pa.Scalar, ids: pa.Scalar) -> Callable[[str], dict]:
    """A field's values by object id, taken from Arrow where they are asked for. Both stay escaped, as they are only compared."""

    def held(field: str) -> dict:
        found = zip(ids.as_py().split(ITEM), vals[list(_types(signature)).index(field)].as_py().split(ITEM))
        return {k: v for k, v in found if k and v}

    return held


def changes(heads: DataFrame) -> DataFrame:
    """(file_id, prev_file_id, field_path, change, old_types, new_types, new_field): the ordered log of changes between headers.

    Who precedes whom is found on keys and signatures alone, in blocks of a day; where signatures differ, the headers' values then meet
    by row, so that a series with very many files is no hot key.
    """
    first = heads.groupBy("file_id").agg(F.min(F.struct("at", "series", "row", "signature")).alias("_first")).select("file_id", "_first.*")
    order = with_previous(first, ["series"], F.to_date("at"), ["at", "file_id"], ["file_id", "row", "signature"])
    pairs = order.where(F.col("prev_row").isNotNull() & (F.col("signature") != F.col("prev_signature"))).select("row", "prev_row", "file_id", "prev_file_id", "signature", "prev_signature")
    new = heads.select("row", F.col("vals").alias("new"), F.col("ids").alias("new_ids"))
    old = heads.select(F.col("row").alias("prev_row"), F.col("vals").alias("old"), F.col("ids").alias("old_ids"))
    both = pairs.join(new, "row").join(old, "prev_row").drop("row", "prev_row")
    ids = heads.schema["file_id"].dataType.simpleString()
    names_out = ["field_path", "change", "old_types", "new_types", "new_field"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            signatures = zip(batch.column("prev_signature").to_pylist(), batch.column("signature").to_pylist())
            for i, (was, now) in enumerate(signatures):
                old, new = (_values(s, batch.column(k)[i], batch.column(f"{k}_ids")[i]) for s, k in ((was, "old"), (now, "new")))
                rows += [(i, *c) for c in compare(_types(was), _types(now), old, new)]
            heads = batch.select(["file_id", "prev_file_id"]).take(pa.array([r[0] for r in rows], pa.int64()))
            made = [pa.array([r[k + 1] if k in (1, 2, 3) or r[k + 1] is None else _unescaped(r[k + 1]) for r in rows], pa.string()) for k in range(len(names_out))]
            yield pa.RecordBatch.from_arrays([*heads.columns, *made], [*heads.schema.names, *names_out])

    return both.mapInArrow(run, f"file_id {ids}, prev_file_id {ids}, field_path string, change string, old_types string, new_types string, new_field string")


def _unescaped(text: str) -> str:
    for letter, escape in reversed(ESCAPES.items()):
        text = text.replace(escape, letter)
    return text


def _unescaped_column(text: Column) -> Column:
    for letter, escape in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(escape), F.lit(letter))
    return text


def differences(files: DataFrame, records: Sequence[str], **names: str) -> DataFrame:
    """The log of ``changes`` of files."""
    return changes(headers(files, records, **names))


def fold_names(log: DataFrame) -> dict[str, str]:
    """One name for all the names a field has gone by, out of the log of changes: {other name: name}.

    Names that a rename links are one field, and it keeps the name most often left behind. A
    rename counts only if most of the renames to its new name say so, as a few equal values can look
    like one. Only counted pairs of names, the size of a schema, reach the driver.
    """
    counted = log.where("change = 'renamed'").groupBy("field_path", "new_field").agg(F.count(F.lit(1)).alias("n")).collect()
    to: dict[str, int] = {}
    left: dict[str, int] = {}
    for r in counted:
        to[r["new_field"]] = to.get(r["new_field"], 0) + r["n"]
        left[r["field_path"]] = left.get(r["field_path"], 0) + r["n"]
    group: dict[str, str] = {}

    def root(name: str) -> str:
        while group.setdefault(name, name) != name:
            name = group[name]
        return name

    changed = True
    while changed:  # names that are one already speak with one voice
        changed, said = False, {}
        for r in counted:
            pair = (root(r["field_path"]), r["new_field"])
            said[pair] = said.get(pair, 0) + r["n"]
        for (old, new), n in sorted(said.items(), key=lambda x: (-x[1], x[0])):
            if 2 * n > to[new] and root(old) != root(new):
                a, b = sorted((root(old), root(new)), key=lambda f: (-left.get(f, 0), f))
                group[b], changed = a, True
    return {f: root(f) for f in group if root(f) != f}


def _fields_of(signature: Column) -> Column:
    """The fields of a signature, types behind them; an empty one has none."""
    return F.when(signature == "", F.array().cast("array<string>")).otherwise(F.split(signature, FIELD))


def fold_schema(heads: DataFrame, renames: dict[str, str] | None = None) -> dict[str, str]:
    """The union schema: every field with the least type that holds all its values.

    Types are gathered as bits, pre-aggregated; one row a field, the size of a schema, reaches the driver.
    """
    kinds = [*SIZES, "double", "boolean", "array"]
    parts = F.split("f.field", PART)
    sized = F.element_at(F.array(*map(F.lit, SIZES)), F.col("f.size") + 1)
    kind = F.explode(F.transform(F.split(parts[1], ","), lambda t: F.when(t == "integer", sized).otherwise(t)))
    bit = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, 1 << i)]), F.col("kind"))
    fields = F.explode(F.arrays_zip(_fields_of(F.col("signature")).alias("field"), F.col("sizes").alias("size"))).alias("f")
    found = heads.select(fields).select(_unescaped_column(parts[0]).alias("field"), kind.alias("kind")).groupBy("field").agg(F.bit_or(bit).alias("kinds"))
    union: dict[str, str] = {}
    for r in sorted(found.collect()):
        field = (renames or {}).get(r["field"], r["field"])
        for i, kind in enumerate(kinds):
            if r["kinds"] >> i & 1:
                union[field] = promote(union.get(field, "null"), kind)
    return union


def unified_of(heads: DataFrame, records: Sequence[str], schema: dict[str, str] | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    """``unified`` out of headers that were read ``whole``; no payload is read again, and nothing is shuffled."""
    renames = renames or {}
    union = fold_schema(heads, renames) if schema is None else schema
    sources = {f: [f, *sorted(n for n, to in renames.items() if to == f)] for f in sorted(union)}
    names = {n: f"_{i}" for i, n in enumerate(dict.fromkeys(n for found in sources.values() for n in found))}
    kept = [c for c in heads.schema["kept"].dataType.names if c != "none"]
    of_field = F.transform(_fields_of(F.col("signature")), lambda f: _unescaped_column(F.split(f, PART)[0]))
    listed = lambda text: F.split(text, ITEM)
    values = [F.coalesce(listed(F.element_at("_m", F.lit(n))), F.array().cast("array<string>")).alias(at) for n, at in names.items()]
    zipped = F.arrays_zip(F.col("places").alias("pos"), F.col("held").alias("held"), listed(F.col("ids")).alias("id"), *values)
    rows = heads.where(F.size("places") > 0).withColumn("_m", F.map_from_arrays(of_field, "vals")).select("file_id", "kept", F.explode(zipped).alias("z"))
    parts = F.filter(F.array(*[F.when(F.col("z.held").bitwiseAND(1 << i) != 0, F.lit(r)) for i, r in enumerate(records)]), lambda x: x.isNotNull())
    rows = rows.select("file_id", "kept", "z", F.explode(parts).alias("record"))

    def plain(text: Column) -> Column:
        """A list's element without its letter; null if it is empty."""
        return F.when(text != "", _unescaped_column(F.substring(text, 2, 2**31 - 1)))

    def cast(field: str, kind: str) -> Column:
        value = F.coalesce(*[F.when((F.col("record") == n.split(".", 1)[0]) & (F.col(f"z.{names[n]}") != ""), F.col(f"z.{names[n]}")) for n in sources[field]])
        return plain(value).try_cast(SPARK_TYPE[kind]).alias(field.replace(".", "__"))

    return rows.select(
        "file_id", *[F.col(f"kept.`{k}`") for k in kept], F.col("z.pos").alias("object_pos"), plain(F.col("z.id")).alias("object_id"), "record", *(cast(f, k) for f, k in sorted(union.items()))
    )


def unified(files: DataFrame, records: Sequence[str], schema: dict[str, str] | None = None, renames: dict[str, str] | None = None, keep: Sequence[str] = (), **names: str) -> DataFrame:
    """One row per object and record of every readable file, with the union schema's fields as columns.

    Columns: file_id, ``keep``, object_pos, object_id, record, then one column per field
    (dots become double underscores), cast to its folded type. A field that a file lacks is null.
    With ``renames`` (see ``fold_names``) a field has one column, whatever name a file has it under;
    should an object hold it twice, the name it is folded to comes first, then the others in their order.
    """
    return unified_of(headers(files, records, keep=keep, whole=True, **names), records, schema, renames)
