"""Headings: declared attribute types, order-free equality, canonical columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import BadValue, HeadingMismatch, UnknownType

SCALARS: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "wideInt": T.LongType(),
    "bignum": T.DecimalType(38, 0),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "bytearray": T.BinaryType(),
    "list": T.ArrayType(T.StringType()),
    "dict": T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])),
}
_NAMES = {"string": "string", "int": "int", "bigint": "long", "decimal(38,0)": "bignum", "double": "double", "boolean": "boolean", "binary": "bytearray"}


def quoted(name: str) -> Column:
    """The column of this exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_type(declared: object) -> T.DataType:
    """Spark type of a declared one: a name, a DataType, ("Tuple", heading) or ("Relation", heading)."""
    if isinstance(declared, T.DataType):
        return declared
    if isinstance(declared, str) and declared in SCALARS:
        return SCALARS[declared]
    if isinstance(declared, tuple) and len(declared) == 2 and declared[0] in ("Tuple", "Relation"):
        inner = struct_type(dict(sorted(declared[1].items())))
        return inner if declared[0] == "Tuple" else T.ArrayType(inner)
    raise UnknownType(declared)


def struct_type(heading: Mapping[str, object]) -> T.StructType:
    return T.StructType([T.StructField(n, data_type(t)) for n, t in heading.items()])


def plain(kind: T.DataType) -> str:
    """Type as text that ignores nullability and the order of nested attributes."""
    if isinstance(kind, T.StructType):
        return "Tuple {" + " ".join(f"{f.name} {{{plain(f.dataType)}}}" for f in sorted(kind.fields, key=lambda f: f.name)) + "}"
    if isinstance(kind, T.ArrayType):
        inner = plain(kind.elementType)
        return "Relation" + inner.removeprefix("Tuple") if isinstance(kind.elementType, T.StructType) else f"list {{{inner}}}"
    return kind.simpleString()


def heading_of(schema: T.StructType) -> dict[str, str]:
    return {f.name: plain(f.dataType) for f in schema.fields}


def shown(kind: T.DataType) -> str:
    """Type as shown to people."""
    if isinstance(kind, T.StructType):
        return "Tuple"
    if isinstance(kind, T.ArrayType):
        return "Relation" if isinstance(kind.elementType, T.StructType) else "list"
    return _NAMES.get(kind.simpleString(), kind.simpleString())


def same_heading(a: T.StructType, b: T.StructType) -> None:
    if heading_of(a) != heading_of(b):
        raise HeadingMismatch(f"{heading_of(a)} and {heading_of(b)}")


def is_relation(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def is_tuple(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType)


def nested_tuple(names: list[str]) -> Column:
    """Tuple-valued column: attributes by name, so that equality ignores their order."""
    if not names:
        return F.expr("named_struct()")
    return F.struct(*(quoted(n).alias(n) for n in sorted(names)))


def canonical(column: Column) -> Column:
    """Relation-valued column in the one form that makes set equality array equality."""
    return F.array_sort(F.array_distinct(column))


def coerce(value: object, kind: T.DataType, name: str) -> object:
    """A Python value of the declared type, or BadValue."""
    if value is None:
        raise BadValue(f"{name}: null")
    try:
        if isinstance(kind, T.StructType):
            return tuple(coerce(value[f.name], f.dataType, f.name) for f in kind.fields)
        if is_relation(kind):
            return sorted({coerce(v, kind.elementType, name) for v in value})
        if isinstance(kind, T.ArrayType):
            return [coerce(v, kind.elementType, name) for v in value]
        if isinstance(kind, T.StringType):
            return str(value)
        if isinstance(kind, T.BooleanType):
            if isinstance(value, bool) or value in (0, 1):
                return bool(value)
            raise BadValue(f"{name}: {value!r}")
        if isinstance(kind, (T.IntegerType, T.LongType)):
            if isinstance(value, bool) or (isinstance(value, float)) or str(int(value)) != str(value).strip().lstrip("+"):
                raise BadValue(f"{name}: {value!r}")
            bits = 31 if isinstance(kind, T.IntegerType) else 63
            if not -(1 << bits) <= int(value) < 1 << bits:
                raise BadValue(f"{name}: {value!r}")
            return int(value)
        if isinstance(kind, T.DecimalType):
            from decimal import Decimal

            out = Decimal(value)
            if out != out.to_integral_value() or len(out.as_tuple().digits) > 38:
                raise BadValue(f"{name}: {value!r}")
            return out
        if isinstance(kind, T.DoubleType):
            return float(value)
        if isinstance(kind, T.BinaryType):
            return bytes(value)
    except BadValue:
        raise
    except (TypeError, ValueError, KeyError, ArithmeticError) as e:
        raise BadValue(f"{name}: {value!r}") from e
    return value
