"""Stores: a Parquet table for each relvar and a JSON manifest; merging; SQL text.

Everything goes through Spark's writers and readers, so a store can be on any
file system that Spark reads. A store is written to a new version's folder
first; the manifest that names the version is written last.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Mapping
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .. import errors as E
from ..catalog import Catalog
from ..relation import Relation
from ..types import same_heading, shown

VERSION = 1
_DECLARED = {"association": ("referring", "attrs", "spec", "to", "to_attrs", "to_spec"), "correlation": ("relvar", "attrs_a", "spec_a", "rel_a", "id_a", "attrs_b", "spec_b", "rel_b", "id_b", "complete")}
_SQL_WORDS = frozenset("all alter and as between by case check collate column commit constraint create cross current default delete desc distinct drop else end escape except exists foreign from full group having in index inner insert intersect into is join key left like limit natural not null on or order outer primary references right rollback select set table then to transaction trigger union unique update using values view when where".split())
_SQL_TYPES = {"int": "integer", "long": "integer", "bignum": "numeric", "double": "real", "boolean": "integer", "bytearray": "blob"}


def _manifest(catalog: Catalog, pattern: str) -> dict:
    names = catalog.names(pattern)
    kept = [c for c in catalog.constraint_names() if set(catalog._constraints[c].relvars) <= set(names)]
    return {
        "version": VERSION,
        "relvars": {n: {"heading": json.loads(catalog["::" + n]._df.schema.json()), "identifiers": catalog.identifiers("::" + n)} for n in names},
        "constraints": [catalog.constraint_info(c) for c in kept if catalog._constraints[c].kind != "procedural"],
    }


def save(catalog: Catalog, path: str, pattern: str = "*") -> None:
    """Write the relvars that match. Procedural constraints are code and are not stored."""
    manifest = _manifest(catalog, pattern)
    version = uuid.uuid4().hex
    folders = {n: f"{version}/{i}" for i, n in enumerate(manifest["relvars"])}
    for n, folder in folders.items():
        catalog["::" + n].df.write.parquet(f"{path}/{folder}")
    text = json.dumps(manifest | {"folders": folders})
    catalog.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _read(spark: SparkSession, path: str) -> tuple[dict, dict[str, Relation]]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["version"] != VERSION:
        raise E.AlgebraError(f"store version {manifest['version']}")
    values = {}
    for n, folder in manifest["folders"].items():
        schema = T.StructType.fromJson(manifest["relvars"][n]["heading"])
        values[n] = Relation(spark.read.schema(schema).parquet(f"{path}/{folder}"), keys=manifest["relvars"][n]["identifiers"])
    return manifest, values


def _create(catalog: Catalog, name: str, relvar: Mapping) -> None:
    schema = T.StructType.fromJson(relvar["heading"])
    catalog.create("::" + name, {f.name: f.dataType for f in schema.fields}, *relvar["identifiers"])


def _constrain(catalog: Catalog, info: Mapping) -> None:
    if info["kind"] == "partition":
        catalog.partition(info["name"], info["whole"], info["attrs"], *((p, a) for p, a in info["parts"]))
    else:
        getattr(catalog, info["kind"])(info["name"], *(info[k] for k in _DECLARED[info["kind"]]))


def load(spark: SparkSession, path: str, into: Catalog | None = None) -> Catalog:
    """Relvars and constraints of a store, its tuples set in one transaction."""
    catalog = Catalog(spark) if into is None else into
    manifest, values = _read(spark, path)
    for n, relvar in manifest["relvars"].items():
        _create(catalog, n, relvar)
    for info in manifest["constraints"]:
        _constrain(catalog, info)
    with catalog.transaction():
        for n, value in values.items():
            catalog.set("::" + n, value)
    return catalog


def merge(catalog: Catalog, path: str) -> list[str]:
    """Add a store: new relvars whole, to others the tuples with new identifiers.

    Returns the names of relvars and constraints that differ and were left alone.
    """
    return merge_values(catalog, *_read(catalog.spark, path))


def merge_values(catalog: Catalog, manifest: dict, values: dict[str, Relation]) -> list[str]:
    """merge() with what a store holds."""
    differ, new = [], set()
    for n, relvar in manifest["relvars"].items():
        if not catalog.exists("::" + n):
            _create(catalog, n, relvar)
            new.add(n)
            continue
        try:
            same_heading(catalog["::" + n]._df.schema, values[n]._df.schema)
        except E.HeadingMismatch:
            differ.append(n)
    differ += [info["name"] for info in manifest["constraints"] if set(differ) & set(_concerned(info))]
    with catalog.transaction():
        for n, value in values.items():
            if n in new:
                catalog.set("::" + n, value)
            elif n not in differ:
                catalog.uinsert("::" + n, value)
        for info in manifest["constraints"]:
            if info["name"] in differ:
                continue
            if catalog.constraint_exists(info["name"]):
                if catalog.constraint_info(info["name"]) != info:
                    differ.append(info["name"])
            elif new & set(_concerned(info)):
                _constrain(catalog, info)
    return differ


def _concerned(info: Mapping) -> list[str]:
    return {"association": lambda: [info["referring"], info["to"]], "partition": lambda: [info["whole"], *(p for p, _ in info["parts"])], "correlation": lambda: [info["relvar"], info["rel_a"], info["rel_b"]]}[info["kind"]]()


def to_plain(value: object, kind: T.DataType):
    """A value as JSON holds it."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: to_plain(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [to_plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.BinaryType):
        return base64.b64encode(bytes(value)).decode()
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return value.isoformat()
    return str(value) if isinstance(kind, T.DecimalType) else value


def from_plain(value: object, kind: T.DataType):
    """The value that to_plain() was given."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: from_plain(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [from_plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.BinaryType):
        return base64.b64decode(value)
    if isinstance(kind, T.TimestampType):
        return datetime.fromisoformat(value)
    if isinstance(kind, T.DateType):
        return date.fromisoformat(value)
    return Decimal(value) if isinstance(kind, T.DecimalType) else value


def serialize(catalog: Catalog, pattern: str = "*") -> dict:
    """Relvars, constraints and tuples as values that JSON holds; for small catalogs."""
    manifest = _manifest(catalog, pattern)
    body = lambda value: [to_plain(t, value._df.schema) for t in value.body()]
    return manifest | {"values": {n: body(catalog["::" + n]) for n in manifest["relvars"]}}


def serialize_to_file(catalog: Catalog, path: str, pattern: str = "*") -> None:
    """serialize() as JSON in a file of the host program."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(serialize(catalog, pattern), f)


def deserialize(spark: SparkSession, value: Mapping, into: Catalog | None = None) -> Catalog:
    catalog = Catalog(spark) if into is None else into
    for n, relvar in value["relvars"].items():
        _create(catalog, n, relvar)
    for info in value["constraints"]:
        _constrain(catalog, info)
    with catalog.transaction():
        for n, body in value["values"].items():
            schema = T.StructType.fromJson(value["relvars"][n]["heading"])
            catalog.set("::" + n, Relation.create(spark, catalog._find("::" + n).heading, *(from_plain(t, schema) for t in body)))
    return catalog


def deserialize_from_file(spark: SparkSession, path: str, into: Catalog | None = None) -> Catalog:
    with open(path, encoding="utf-8") as f:
        return deserialize(spark, json.load(f), into)


def dump(catalog: Catalog, pattern: str = "*") -> str:
    """Python text that rebuilds the relvars; run it with catalog defined."""
    state = json.dumps(serialize(catalog, pattern))
    return f"import json\n\nfrom tuplewise.sources.store import deserialize\n\ndeserialize(catalog.spark, json.loads({state!r}), catalog)\n"


def dump_to_file(catalog: Catalog, path: str, pattern: str = "*") -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(dump(catalog, pattern))


def sql_name(name: str) -> str:
    """A name that SQL takes unquoted."""
    out = re.sub(r"\W", "_", name)
    return f"{out}_K" if out.lower() in _SQL_WORDS else out


def sql_schema(catalog: Catalog, pattern: str = "*") -> str:
    """DDL of the relvars: not null, unique, foreign keys and their indexes."""
    join = lambda attrs: ", ".join(map(sql_name, attrs))
    out = ["pragma foreign_keys=ON;"]
    for n in catalog.names(pattern):
        infos = [catalog.constraint_info(c) for c in catalog.constraint_member("::" + n)]
        loose = {a for i in infos if i["kind"] == "association" and i["referring"] == n and i["to_spec"] == "?" for a in i["attrs"]}
        table, lines, indexes = sql_name(n), [], []
        for f in catalog["::" + n]._df.schema.fields:
            kind = _SQL_TYPES.get(shown(f.dataType), "text")
            lines.append(f"{sql_name(f.name)} {kind}" + ("" if f.name in loose else " not null"))
        for k, i in enumerate(catalog.identifiers("::" + n), 1):
            lines.append(f"constraint {table}_ID{k} unique ({join(i)})")
        for i in infos:
            refs = []
            if i["kind"] == "association" and i["referring"] == n:
                refs = [(i["attrs"], i["to"], i["to_attrs"], "set null" if i["to_spec"] == "?" else "cascade")]
            elif i["kind"] == "partition":
                refs = [(a, i["whole"], i["attrs"], "cascade") for p, a in i["parts"] if p == n]
            elif i["kind"] == "correlation" and i["relvar"] == n:
                refs = [(i["attrs_a"], i["rel_a"], i["id_a"], "cascade"), (i["attrs_b"], i["rel_b"], i["id_b"], "cascade")]
            for k, (attrs, to, to_attrs, gone) in enumerate(refs):
                name = f"{table}_{sql_name(i['name'])}" + (f"_{k}" if len(refs) > 1 else "")
                lines.append(f"constraint {name} foreign key ({join(attrs)}) references {sql_name(to)} ({join(to_attrs)}) on delete {gone} on update cascade deferrable initially deferred")
                indexes.append(f"create index {name}_INDEX on {table} ({join(attrs)});")
        out.append(f"create table {table} (\n    " + ",\n    ".join(lines) + "\n);")
        out += indexes
    return "\n".join(out) + "\n"
