"""Relation variables: identifiers, transactions, constraints and traces.

A relvar is a catalog record that points to an immutable relation. A statement
builds a new relation and swaps the pointer; identifiers and constraints are
checked when the outermost transaction ends, each by one small job, and a
failure restores the pointers.

Inserts and deletes are deltas: what is new is written to the shared folder and
joins what is there, and identifiers and constraints are checked for the keys of
the delta only. Other statements write the whole relvar and check all of it.
After some deltas a relvar is written whole, so plans don't grow without end.

Names live in namespaces: "::a::b" is absolute, other names are looked up in
the current namespace and then in the global one.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors as E
from .operators.ordering import number
from .plans.scratch import write_scratch
from .relation import Relation
from .types import quoted, struct_type

SPECS = ("1", "+", "?", "*")
OPERATIONS = ("delete", "insert", "set", "unset", "update")


@dataclass
class Relvar:
    name: str
    identifiers: list[tuple[str, ...]]
    value: Relation
    heading: dict
    traces: list[tuple[tuple[str, ...], Callable]] = field(default_factory=list)
    tracing: bool = False
    deltas: int = 0


@dataclass
class Constraint:
    """kind, the relvars concerned, and what was declared."""

    name: str
    kind: str
    relvars: list[str]
    info: dict
    check: Callable[[Catalog, Changes | None], str | None]


#: By relvar: tuples that came or went, or None where any may have changed.
Changes = dict[str, "list[DataFrame] | None"]
#: A relvar of more deltas than this is written whole.
DELTAS = 8


class Catalog:
    """A set of relvars and constraints, modified by statements and transactions."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._relvars: dict[str, Relvar] = {}
        self._constraints: dict[str, Constraint] = {}
        self._saved: list[dict[str, Relation]] = []
        self._watchers: list[Callable[[str, int], None]] = []
        self._changes: Changes = {}
        self._quiet = 0
        self.namespace = ""

    # Lookup

    def __getitem__(self, name: str) -> Relation:
        return self._find(name).value

    def _find(self, name: str) -> Relvar:
        for n in self._candidates(name):
            if n in self._relvars:
                return self._relvars[n]
        raise E.UnknownRelvar(name)

    def _candidates(self, name: str) -> list[str]:
        """Where a name is looked up: as an absolute one, or here and then globally."""
        if name.startswith("::"):
            return [name[2:]]
        return [f"{self.namespace}::{name}", name] if self.namespace else [name]

    @contextmanager
    def within(self, namespace: str) -> Iterator[Catalog]:
        """Names are created and looked up first in this namespace; relative ones nest."""
        before = self.namespace
        self.namespace = namespace[2:] if namespace.startswith("::") else f"{before}::{namespace}" if before else namespace
        try:
            yield self
        finally:
            self.namespace = before

    def exists(self, name: str) -> bool:
        return any(n in self._relvars for n in self._candidates(name))

    def names(self, pattern: str = "*") -> list[str]:
        """Names that match, without the leading :: of absolute ones."""
        return sorted(n for n in self._relvars if fnmatch.fnmatchcase(n, pattern.removeprefix("::")))

    def path(self, name: str) -> str:
        """The absolute name."""
        return "::" + self._find(name).name

    def identifiers(self, name: str) -> list[tuple[str, ...]]:
        return list(self._find(name).identifiers)

    # Definition

    def create(self, name: str, heading: Mapping[str, object], *identifiers: Sequence[str]) -> Relation:
        """A new, empty relvar with one or more identifiers."""
        if self._saved:
            raise E.InTransaction("create")
        name = self._candidates(name)[0]
        if name in self._relvars:
            raise E.DuplicateName(name)
        ids = [(i,) if isinstance(i, str) else tuple(i) for i in identifiers]
        if not ids:
            raise E.BadIdentifier("none given")
        for i in ids:
            if not i or len(set(i)) < len(i):
                raise E.BadIdentifier(i)
            for a in i:
                if a not in heading:
                    raise E.UnknownAttribute(a)
            if any(set(i) <= set(j) for j in ids if j is not i):
                raise E.BadIdentifier(f"{i} is part of another one")
        value = Relation.create(self.spark, heading)
        self._relvars[name] = Relvar(name, ids, Relation(value.df, keys=ids), dict(heading))
        return self._relvars[name].value

    def unset(self, *names: str) -> None:
        if self._saved:
            raise E.InTransaction("unset")
        for n in names:
            relvar = self._find(n)
            n = relvar.name
            if any(n in c.relvars for c in self._constraints.values()):
                raise E.HasConstraints(n)
            for operations, f in reversed(relvar.traces):
                if "unset" in operations and not self._quiet:
                    try:
                        f(n)
                    except Exception:  # noqa: BLE001  an unset trace can't stop it
                        continue
            del self._relvars[n]

    # Transactions

    @contextmanager
    def transaction(self) -> Iterator[Catalog]:
        """Statements inside take effect together, or not at all."""
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.end()

    eval = transaction

    def begin(self) -> None:
        self._saved.append({})
        self._tell("begin")

    def end(self) -> None:
        """Commit; the outermost one checks identifiers and constraints first."""
        if not self._saved:
            raise E.NoTransaction()
        self._tell("end")
        if len(self._saved) > 1:
            inner = self._saved.pop()
            self._saved[-1] = {**inner, **self._saved[-1]}
            return
        try:
            self._validate()
        except BaseException:
            self._restore(self._saved.pop())
            raise
        finally:
            self._changes = {}
        self._saved.pop()

    def rollback(self) -> None:
        if not self._saved:
            raise E.NoTransaction()
        self._tell("end")
        self._restore(self._saved.pop())
        if not self._saved:
            self._changes = {}

    def _restore(self, saved: dict[str, Relation]) -> None:
        for n, value in saved.items():
            self._relvars[n].value = value

    def _tell(self, what: str) -> None:
        if not self._quiet:
            for f in reversed(self._watchers):
                try:
                    f(what, len(self._saved))
                except Exception:  # noqa: BLE001  such a trace can't stop a transaction
                    continue

    def _changed(self, relvar: Relvar, delta: DataFrame | None) -> None:
        """Note tuples that came or went; None: any may have changed."""
        known = self._changes.setdefault(relvar.name, [])
        if delta is None:
            self._changes[relvar.name] = None
        elif known is not None:
            known.append(delta)

    def _validate(self) -> None:
        changed = set(self._saved[-1])
        for n in sorted(changed):
            relvar, deltas = self._relvars[n], self._changes.get(n)
            relvar.deltas = relvar.deltas + 1 if deltas is not None else DELTAS + 1
            if relvar.deltas > DELTAS:
                df, relvar.deltas = write_scratch(relvar.value.df, "relvar")[0], 0
            else:
                df = relvar.value.df
            for i in relvar.identifiers:
                rows = df if deltas is None else _touched(df, i, [(d, i) for d in deltas])
                clash = rows.groupBy(*map(quoted, i)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).collect()
                if clash:
                    raise E.IdentifierViolation(f"{n}: {clash[0].asDict()}")
            relvar.value = Relation(df, keys=relvar.identifiers)
        for c in self._constraints.values():
            if changed & set(c.relvars):
                self._hold(c, {n: self._changes.get(n) if n in changed else [] for n in c.relvars})

    def _hold(self, constraint: Constraint, changes: Changes | None = None) -> None:
        if (why := constraint.check(self, changes)) is not None:
            raise E.ConstraintViolation(f"{constraint.name}: {why}")

    @contextmanager
    def _statement(self, name: str) -> Iterator[Relvar]:
        relvar = self._find(name)
        with self.transaction():
            self._saved[-1].setdefault(relvar.name, relvar.value)
            yield relvar

    def _trace(self, relvar: Relvar, operation: str, df: DataFrame) -> DataFrame:
        """df as the traces of this operation leave it, the latest first."""
        if self._quiet or relvar.tracing:
            return df
        relvar.tracing = True
        try:
            for operations, f in reversed(relvar.traces):
                if operation in operations:
                    out = f(df)
                    df = df if operation == "delete" or out is None else out
        finally:
            relvar.tracing = False
        return df

    # Statements

    def set(self, name: str, value: Relation) -> Relation:
        """Assign a relation of the same heading."""
        with self._statement(name) as relvar:
            df = relvar.value._aligned(value, "set")
            new = Relation(self._trace(relvar, "set", Relation(df, value.is_set).df))
            relvar.value = Relation(relvar.value._aligned(new, "set"), new.is_set)
            self._changed(relvar, None)
        return self[name]

    def _literal(self, relvar: Relvar, tuples: Sequence[Mapping[str, object]] | Relation) -> DataFrame:
        """New tuples; attributes that are left out are null until an insert trace fills them."""
        if isinstance(tuples, Relation):
            return relvar.value._aligned(tuples, "insert")
        given = {a for t in tuples for a in t}
        if given == set(relvar.heading):
            return Relation.create(self.spark, relvar.heading, *tuples).df
        if given - set(relvar.heading) or not relvar.traces:
            raise E.WrongAttributes(sorted(given))
        part = Relation.create(self.spark, {a: k for a, k in relvar.heading.items() if a in given}, *tuples).df
        schema = struct_type(relvar.heading)
        return part.select(*(quoted(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))

    def _complete(self, relvar: Relvar, df: DataFrame) -> DataFrame:
        df = self._trace(relvar, "insert", df)
        df = relvar.value._aligned(Relation(df), "insert")
        missing = reduce(Column.__or__, (quoted(a).isNull() for a in relvar.heading))
        if not df.filter(missing & ~self._conditional(relvar)).isEmpty():
            raise E.NullValue(relvar.name)
        return df

    def _conditional(self, relvar: Relvar) -> Column:
        """Whether the nulls of a tuple are all in conditional references."""
        loose = {a for c in self._constraints.values() if c.kind == "association" and c.info["referring"] == relvar.name and c.info["to_spec"] == "?" for a in c.info["attrs"]}
        strict = [quoted(a).isNull() for a in relvar.heading if a not in loose]
        return ~reduce(Column.__or__, strict) if strict else F.lit(True)

    def insert(self, name: str, *tuples: Mapping[str, object] | Relation) -> Relation:
        """Add tuples; one that is there, or whose identifier is, fails. Returns them."""
        with self._statement(name) as relvar:
            new = self._complete(relvar, self._literal(relvar, tuples[0] if tuples and isinstance(tuples[0], Relation) else tuples))
            new, _ = write_scratch(new, "inserted")
            relvar.value = Relation(relvar.value.df.union(new), True)  # repeated tuples repeat an identifier
            self._changed(relvar, new)
        return Relation(new)

    def uinsert(self, name: str, *tuples: Mapping[str, object] | Relation) -> Relation:
        """Add those tuples whose identifiers are all new; of equal ones among them, the least. Returns them."""
        with self._statement(name) as relvar:
            new = Relation(self._complete(relvar, self._literal(relvar, tuples[0] if tuples and isinstance(tuples[0], Relation) else tuples))).df
            for i in relvar.identifiers:
                new = new.join(relvar.value.df.select(*map(quoted, i)), list(i), "left_anti")
                row = F.struct(*map(quoted, relvar.heading))
                new = new.groupBy(*map(quoted, i)).agg(F.min(row).alias("_t")).select("_t.*")
            new, _ = write_scratch(new.select(*map(quoted, relvar.heading)), "inserted")
            relvar.value = Relation(relvar.value.df.union(new), True)
            self._changed(relvar, new)
        return Relation(new, True)

    def delete(self, name: str, condition: Column | str) -> int:
        """Remove tuples for which the condition holds; their number."""
        test = F.expr(condition) if isinstance(condition, str) else condition
        with self._statement(name) as relvar:
            gone, _ = write_scratch(relvar.value.df.filter(test), "deleted")
            self._trace(relvar, "delete", gone)
            n = gone.count()
            left = relvar.value.df.filter(~F.coalesce(test, F.lit(False)))
            if not left._jdf.queryExecution().analyzed().deterministic():
                left = relvar.value.df.subtract(gone)
            relvar.value = Relation(left, True, relvar.identifiers)
            self._changed(relvar, gone)
        return n

    def _identified(self, relvar: Relvar, key: Mapping[str, object]) -> Column:
        if not any(set(i) == set(key) for i in relvar.identifiers):
            raise E.NotIdentifier(sorted(key))
        return reduce(Column.__and__, (quoted(a) == F.lit(v) for a, v in key.items()))

    def deleteone(self, name: str, key: Mapping[str, object]) -> int:
        """Remove the tuple with this identifier value; 0 or 1."""
        return self.delete(name, self._identified(self._find(name), key))

    def restrictone(self, name: str, key: Mapping[str, object]) -> Relation:
        """The tuple with this identifier value, or none."""
        return self[name].restrict(self._identified(self._find(name), key))

    def update(self, name: str, condition: Column | str, values: Mapping[str, Column | str]) -> Relation:
        """New values where the condition holds. Returns the updated tuples."""
        test = F.expr(condition) if isinstance(condition, str) else condition
        with self._statement(name) as relvar:
            test = F.coalesce(test, F.lit(False))
            old = relvar.value.df.filter(test).withColumn("_old", F.struct(*map(quoted, relvar.heading)))
            new = self._updated(relvar, Relation(old, True).update(F.lit(True), values)._df)
            new, _ = write_scratch(new, "updated")
            relvar.value = Relation(relvar.value.df.filter(~test).union(new))
            self._changed(relvar, None)
        return Relation(new)

    def _updated(self, relvar: Relvar, df: DataFrame) -> DataFrame:
        """New tuples as the update traces leave them; they see the tuple before as the struct _old."""
        df = self._trace(relvar, "update", df)
        return relvar.value._aligned(Relation(df.drop("_old")), "update")

    def update_each(self, name: str, condition: Column | str, change: Callable[[dict], Mapping | None]) -> Relation:
        """New values for one tuple after the other, by a function of the host language.

        It returns what changes, or None to leave a tuple; StopIteration ends
        the loop and keeps what was done. Tuples come through the driver one
        partition at a time; what changed is held there.
        """
        test = F.expr(condition) if isinstance(condition, str) else condition
        with self._statement(name) as relvar:
            old, new = [], []
            for r in relvar.value.df.filter(test).toLocalIterator():
                row = r.asDict(recursive=True)
                try:
                    values = change(dict(row))
                except StopIteration:
                    break
                if values is not None:
                    old.append(row)
                    new.append({**row, **values})
            there = struct_type(relvar.heading)
            before, after = (self.spark.createDataFrame([tuple(t[n] for n in there.names) for t in x], there) for x in (old, new))
            pairs = self.spark.createDataFrame([(*(t[n] for n in there.names), tuple(o[n] for n in there.names)) for o, t in zip(old, new)], there.add("_old", struct_type(relvar.heading)))
            after, _ = write_scratch(self._updated(relvar, pairs), "updated")
            relvar.value = Relation(relvar.value.df.subtract(before).union(after))
            self._changed(relvar, None)
        return Relation(after)

    def updateone(self, name: str, key: Mapping[str, object], values: Mapping[str, Column | str]) -> Relation:
        """New values for the tuple with this identifier value."""
        return self.update(name, self._identified(self._find(name), key), values)

    def updateper(self, name: str, per: Relation) -> Relation:
        """New values from per, matched by the identifiers it holds. Returns the updated tuples."""
        with self._statement(name) as relvar:
            held = [i for i in relvar.identifiers if set(i) <= set(per.attributes)]
            for a in per.attributes:
                if relvar.value.heading.get(a) != per.heading[a]:
                    raise E.NotProjection(a)
            if not held:
                raise E.NotIdentifier(per.attributes)
            keys = list(dict.fromkeys(a for i in held for a in i))
            values = [a for a in per.attributes if a not in keys]
            right = per.df.select(*(quoted(a).alias(f"_k{i}") for i, a in enumerate(keys)), *(quoted(a).alias(f"_v{i}") for i, a in enumerate(values)), F.lit(True).alias("_hit"))
            row = F.struct(*map(quoted, relvar.heading)).alias("_old")
            on = reduce(Column.__and__, (quoted(a) == F.col(f"_k{i}") for i, a in enumerate(keys)))
            both = relvar.value.df.join(right, on, "left")
            out = both.select(*(F.when(F.col("_hit"), F.col(f"_v{values.index(a)}")).otherwise(quoted(a)).alias(a) if a in values else quoted(a) for a in relvar.heading), F.coalesce("_hit", F.lit(False)).alias("_hit"), row)
            out, _ = write_scratch(out, "updated")
            new = self._updated(relvar, out.filter("_hit").drop("_hit"))
            relvar.value = Relation(out.filter("not _hit").drop("_hit", "_old").union(new))
            self._changed(relvar, None)
        return Relation(new)

    def union(self, name: str, *others: Relation) -> Relation:
        return self.set(name, self[name].union(*others))

    def dunion(self, name: str, *others: Relation) -> Relation:
        return self.set(name, self[name].dunion(*others))

    def intersect(self, name: str, *others: Relation) -> Relation:
        return self.set(name, self[name].intersect(*others))

    def minus(self, name: str, other: Relation) -> Relation:
        return self.set(name, self[name].minus(other))

    # Constraints

    def _declare(self, constraint: Constraint) -> None:
        if constraint.name in self._constraints:
            raise E.DuplicateName(constraint.name)
        self._hold(constraint)
        self._constraints[constraint.name] = constraint

    def _reference(self, name: str, attrs: Sequence[str], of: str, to: Sequence[str]) -> None:
        a, b = self._find(name).value, self._find(of)
        a._has(*attrs)
        b.value._has(*to)
        if len(attrs) != len(to):
            raise E.WrongAttributes(f"{list(attrs)} and {list(to)}")
        if not any(set(i) == set(to) for i in b.identifiers):
            raise E.NotIdentifier(list(to))
        for x, y in zip(attrs, to):
            if a.heading[x] != b.value.heading[y]:
                raise E.TypeMismatch(f"{x} and {y}")

    def association(self, name: str, referring: str, attrs: Sequence[str], spec: str, to: str, to_attrs: Sequence[str], to_spec: str) -> None:
        """Referring tuples refer to one tuple (to_spec 1) or perhaps one (?); each of these is referred to spec times."""
        if spec not in SPECS or to_spec not in ("1", "?"):
            raise E.BadMultiplicity(f"{spec} {to_spec}")
        self._reference(referring, attrs, to, to_attrs)
        referring, to = self._find(referring).name, self._find(to).name
        info = {"referring": referring, "attrs": list(attrs), "spec": spec, "to": to, "to_attrs": list(to_attrs), "to_spec": to_spec}
        self._declare(Constraint(name, "association", [referring, to], info, lambda c, changes: _first(violations(*c._affected(changes, (referring, attrs), (to, to_attrs), between=spec), to_spec))))

    def partition(self, name: str, whole: str, attrs: Sequence[str], *parts: tuple[str, Sequence[str]]) -> None:
        """Every tuple of whole is referred to by exactly one tuple of the parts."""
        if len({p for p, _ in parts}) < len(parts):
            raise E.DuplicateName([p for p, _ in parts])
        for p, a in parts:
            self._reference(p, a, whole, attrs)
        whole, parts = self._find(whole).name, [(self._find(p).name, a) for p, a in parts]
        info = {"whole": whole, "attrs": list(attrs), "parts": [[p, list(a)] for p, a in parts]}
        self._declare(Constraint(name, "partition", [whole, *(p for p, _ in parts)], info, lambda c, changes: _first(_partitioned(c._affected(changes, (whole, attrs), *parts)))))

    def correlation(self, name: str, relvar: str, attrs_a: Sequence[str], spec_a: str, rel_a: str, id_a: Sequence[str], attrs_b: Sequence[str], spec_b: str, rel_b: str, id_b: Sequence[str], complete: bool = False) -> None:
        """An associative relvar between two others; complete: it pairs all of them."""
        if spec_a not in SPECS or spec_b not in SPECS or (complete and (spec_a, spec_b) != ("*", "*")):
            raise E.BadMultiplicity(f"{spec_a} {spec_b}")
        self._reference(relvar, attrs_a, rel_a, id_a)
        self._reference(relvar, attrs_b, rel_b, id_b)
        relvar, rel_a, rel_b = (self._find(n).name for n in (relvar, rel_a, rel_b))

        def check(c: Catalog, changes: Changes | None) -> str | None:
            one = c._affected(changes, (relvar, attrs_a), (rel_a, id_a), between=spec_b)
            two = c._affected(changes, (relvar, attrs_b), (rel_b, id_b), between=spec_a)
            found = _first(violations(*one, "1")) or _first(violations(*two, "1"))
            if found is None and complete and c[relvar].cardinality() != c[rel_a].cardinality() * c[rel_b].cardinality():
                return "not complete"
            return found

        info = {"relvar": relvar, "attrs_a": list(attrs_a), "spec_a": spec_a, "rel_a": rel_a, "id_a": list(id_a), "attrs_b": list(attrs_b), "spec_b": spec_b, "rel_b": rel_b, "id_b": list(id_b), "complete": complete}
        self._declare(Constraint(name, "correlation", [relvar, rel_a, rel_b], info, check))

    def procedural(self, name: str, relvars: Sequence[str], holds: Callable[[Catalog], bool]) -> None:
        """A predicate over the catalog, checked whenever one of the relvars changes."""
        if not relvars:
            raise E.UnknownRelvar("none given")
        relvars = [self._find(n).name for n in relvars]
        self._declare(Constraint(name, "procedural", relvars, {"relvars": relvars}, lambda c, _: None if holds(c) else "predicate is false"))

    def _affected(self, changes: Changes | None, *sides: tuple[str, Sequence[str]], between: str | None = None) -> list:
        """Each side's relation and attributes, of the keys that a delta touches; the whole relations if it can't be told.

        between, if given, stands after the first side.
        """
        values = [self._relvars[n].value for n, _ in sides]
        if changes is not None and all(changes.get(n) is not None for n, _ in sides):
            touched = [(d, a) for n, a in sides for d in changes[n]]
            if touched:
                values = [Relation(_touched(v.df, a, touched), True) for v, (_, a) in zip(values, sides)]
        out = [x for v, (_, a) in zip(values, sides) for x in (v, a)]
        return out if between is None else [*out[:2], between, *out[2:]]

    def constraint_exists(self, name: str) -> bool:
        return name in self._constraints

    def constraint_names(self, pattern: str = "*") -> list[str]:
        return sorted(n for n in self._constraints if fnmatch.fnmatchcase(n, pattern))

    def constraint_info(self, name: str) -> dict:
        if name not in self._constraints:
            raise E.UnknownConstraint(name)
        c = self._constraints[name]
        return {"kind": c.kind, "name": name, **c.info}

    def constraint_path(self, name: str) -> str:
        return self.constraint_info(name)["name"]

    def constraint_member(self, relvar: str) -> list[str]:
        name = self._find(relvar).name
        return sorted(c.name for c in self._constraints.values() if name in c.relvars)

    def constraint_delete(self, *names: str) -> None:
        for n in names:
            self.constraint_info(n)
            del self._constraints[n]

    # Traces

    def trace_add(self, name: str, operations: Sequence[str], f: Callable) -> None:
        """Call f with the DataFrame of a statement's tuples (unset: the name); what it returns takes their place.

        An update's DataFrame has each tuple as it was, too, in the struct _old.
        """
        if not operations or set(operations) - set(OPERATIONS):
            raise E.BadTrace(list(operations))
        self._find(name).traces.append((tuple(operations), f))

    def trace_remove(self, name: str, operations: Sequence[str], f: Callable) -> None:
        traces = self._find(name).traces
        if (tuple(operations), f) in traces:
            traces.remove((tuple(operations), f))

    def trace_info(self, name: str) -> list[tuple[tuple[str, ...], Callable]]:
        return list(reversed(self._find(name).traces))

    def watch_transactions(self, f: Callable[[str, int], None]) -> None:
        """Call f with begin or end and the nesting level."""
        self._watchers.append(f)

    def unwatch_transactions(self, f: Callable[[str, int], None]) -> None:
        self._watchers.remove(f)

    @contextmanager
    def suspended_traces(self) -> Iterator[None]:
        self._quiet += 1
        try:
            yield
        finally:
            self._quiet -= 1


def _touched(df: DataFrame, attrs: Sequence[str], deltas: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Tuples whose values of attrs stand in one of the deltas, under that one's own names."""
    keys = reduce(DataFrame.union, (d.select(*(quoted(a).alias(f"_k{i}") for i, a in enumerate(names))) for d, names in deltas)).distinct()
    return df.join(keys, reduce(Column.__and__, (quoted(a).eqNullSafe(F.col(f"_k{i}")) for i, a in enumerate(attrs))), "left_semi")


def _partitioned(sides: list) -> DataFrame:
    return partition_violations(sides[0], sides[1], list(zip(sides[2::2], sides[3::2])))


def violations(referring: Relation, attrs: Sequence[str], spec: str, to: Relation, to_attrs: Sequence[str], to_spec: str) -> DataFrame:
    """Key values and why they break a reference: one full pass over both key sets."""
    keys = [f"k{i}" for i in range(len(attrs))]
    counts = referring.df.select(*(quoted(a).alias(k) for a, k in zip(attrs, keys))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    there = to.df.select(*(quoted(a).alias(k) for a, k in zip(to_attrs, keys))).withColumn("there", F.lit(True))
    both = counts.join(there, keys, "full")
    why = F.lit(None).cast("string")
    if spec in ("1", "?"):
        why = F.when(F.col("n") > 1, "referred to more than once").otherwise(why)
    if spec in ("1", "+"):
        why = F.when(F.col("n").isNull(), "not referred to").otherwise(why)
    lost = F.col("there").isNull()
    if to_spec == "?":  # a null reference is no reference
        lost &= reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    why = F.when(lost, "refers to nothing").otherwise(why)
    if to_spec == "?":
        why = F.when(reduce(Column.__or__, (F.col(k).isNull() for k in keys)), None).otherwise(why)
    return both.select(*keys, why.alias("why")).filter("why is not null")


def partition_violations(whole: Relation, attrs: Sequence[str], parts: Sequence[tuple[Relation, Sequence[str]]]) -> DataFrame:
    """Key values and why they break a partition."""
    keys = [f"k{i}" for i in range(len(attrs))]
    each = [r.df.select(*(quoted(x).alias(k) for x, k in zip(a, keys))) for r, a in parts]
    counts = reduce(DataFrame.union, each).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    there = whole.df.select(*(quoted(a).alias(k) for a, k in zip(attrs, keys))).withColumn("there", F.lit(True))
    both = counts.join(there, keys, "full")
    why = F.when(F.col("there").isNull(), "refers to nothing").when(F.col("n").isNull(), "in no part").when(F.col("n") > 1, "in more than one part")
    return both.select(*keys, why.alias("why")).filter("why is not null")


def _first(df: DataFrame) -> str | None:
    found = df.limit(1).collect()
    return str(found[0].asDict()) if found else None


def system_ids(catalog: Catalog, name: str, attr: str) -> None:
    """New tuples without this attribute get the numbers after the largest one (from 1)."""

    def fill(df: DataFrame) -> DataFrame:
        kind = df.schema[attr].dataType
        last = catalog[name].df.agg(F.max(quoted(attr))).first()[0] or 0
        keys = [quoted(c) for c in df.columns if c != attr]
        rows = number(df.filter(quoted(attr).isNull()), keys, "_id")
        filled = rows.withColumn(attr, (F.col("_id") + 1 + last).cast(kind)).select(*map(quoted, df.columns))
        return df.filter(quoted(attr).isNotNull()).union(filled)

    catalog.trace_add(name, ["insert"], fill)


def attribute_constraint(catalog: Catalog, name: str, condition: Column | str) -> None:
    """Inserts and updates fail with a tuple for which the condition doesn't hold."""
    test = F.expr(condition) if isinstance(condition, str) else condition

    def check(df: DataFrame) -> DataFrame:
        bad = df.filter(~F.coalesce(test, F.lit(False))).limit(1).collect()
        if bad:
            raise E.ConstraintViolation(f"{name}: {bad[0].asDict()}")
        return df

    catalog.trace_add(name, ["insert", "update"], check)
