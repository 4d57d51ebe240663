"""The text form of relations: a heading and a body, as nested words.

Words are separated by white space; braces hold a word with spaces or further
words, and may be nested. {a int b string} {{a 1 b x} {a 2 b {y z}}}
"""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import BadValue, WrongAttributes
from .types import data_type, is_relation, is_tuple, shown


def words(text: str) -> list[str]:
    """The words of one level."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif text[at] == "{":
            depth, end = 1, at + 1
            while depth:
                if end >= len(text):
                    raise BadValue("unbalanced braces")
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
            out.append(text[at + 1 : end - 1])
            at = end
        else:
            end = at
            while end < len(text) and not text[end].isspace():
                end += 1
            out.append(text[at:end])
            at = end
    return out


def _pairs(text: str) -> list[tuple[str, str]]:
    flat = words(text)
    if len(flat) % 2:
        raise WrongAttributes(text)
    return list(zip(flat[::2], flat[1::2]))


def _kind(text: str) -> T.DataType:
    parts = words(text)
    if len(parts) == 2 and parts[0] in ("Tuple", "Relation"):
        return data_type((parts[0], {n: _kind(t) for n, t in _pairs(parts[1])}))
    return data_type(text)


def _value(text: str, kind: T.DataType):
    if is_relation(kind):
        return [_value(t, kind.elementType) for t in words(text)]
    if is_tuple(kind):
        given = dict(_pairs(text))
        return {f.name: _value(given[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return words(text)
    if isinstance(kind, T.BooleanType):
        if text not in ("0", "1", "true", "false"):
            raise BadValue(text)
        return text in ("1", "true")
    try:
        return int(text) if isinstance(kind, T.IntegralType) else float(text) if isinstance(kind, T.DoubleType) else text
    except ValueError:
        raise BadValue(text) from None


def parsed(text: str) -> tuple:
    """Heading and tuples of a text, as arguments of Relation.create."""
    parts = words(text)
    if len(parts) != 2:
        raise WrongAttributes("a heading and a body are needed")
    heading = {n: _kind(t) for n, t in _pairs(parts[0])}
    tuples = []
    for t in words(parts[1]):
        given = dict(_pairs(t))
        if set(given) != set(heading):
            raise WrongAttributes(sorted(given))
        tuples.append({n: _value(given[n], k) for n, k in heading.items()})
    return heading, *tuples


def _word(text: str) -> str:
    return text if text and not any(c.isspace() or c in "{}" for c in text) else "{" + text + "}"


def _name(kind: T.DataType) -> str:
    if is_relation(kind) or is_tuple(kind):
        inner = kind.elementType if is_relation(kind) else kind
        return "{" + ("Relation" if is_relation(kind) else "Tuple") + " {" + " ".join(f"{_word(f.name)} {_name(f.dataType)}" for f in inner.fields) + "}}"
    return shown(kind)


def _shown(value, kind: T.DataType) -> str:
    if is_relation(kind):
        return "{" + " ".join(_shown(v, kind.elementType) for v in value) + "}"
    if is_tuple(kind):
        return "{" + " ".join(f"{_word(f.name)} {_shown(v, f.dataType)}" for f, v in zip(kind.fields, value)) + "}"
    if isinstance(kind, T.ArrayType):
        return "{" + " ".join(map(_word, value)) + "}"
    return _word(str(int(value)) if isinstance(value, bool) else str(value))


def unparsed(schema: T.StructType, rows: list[list]) -> str:
    heading = " ".join(f"{_word(f.name)} {_name(f.dataType)}" for f in schema.fields)
    return "{" + heading + "} {" + " ".join(_shown(r, schema) for r in rows) + "}"
