"""Relation: a lazy set of tuples over a DataFrame.

Operators return new relations whose DataFrames are not executed. distinct is
added only where an operator can create duplicates and no known key rules
them out. Names are case-sensitive and may hold any character, so the session
runs with spark.sql.caseSensitive=true.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors as E
from .functions.aggregates import Aggregate, rcount
from .operators.closure import transitive_closure
from .operators.ordering import competition_rank, tagged
from .streaming.guard import whole
from .textform import parsed, unparsed
from .types import canonical, coerce, data_type, heading_of, is_relation, is_tuple, nested_tuple, plain, quoted, same_heading, struct_type

Using = Mapping[str, str] | None


class Relation:
    """A set of tuples with a typed heading; keys are attribute sets known to be unique."""

    def __init__(self, df: DataFrame, is_set: bool = False, keys: Sequence[Sequence[str]] = ()):
        df.sparkSession.conf.set("spark.sql.caseSensitive", "true")
        names = df.columns
        if len(set(names)) < len(names):
            raise E.DuplicateAttribute(sorted({n for n in names if names.count(n) > 1}))
        self.keys = tuple(frozenset(k) for k in keys)
        self.is_set = is_set or bool(self.keys)
        self._df = df

    @property
    def df(self) -> DataFrame:
        """The tuples, each once."""
        return self._df if self.is_set else whole(self._df, "distinct").distinct()

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    def _whole(self, operator: str) -> DataFrame:
        return whole(self.df, operator)

    # Sources

    @classmethod
    def create(cls, spark: SparkSession, heading: Mapping[str, object], *tuples: Mapping[str, object]) -> Relation:
        """Literal of named values; a repeated tuple is an error."""
        schema = struct_type(heading)
        rows = []
        for t in tuples:
            if set(t) != set(schema.names):
                raise E.WrongAttributes(f"{sorted(t)} for {schema.names}")
            rows.append(tuple(coerce(t[f.name], f.dataType, f.name) for f in schema.fields))
        seen: set = set()
        for r in rows:
            if (k := repr(r)) in seen:
                raise E.DuplicateTuple(r)
            seen.add(k)
        return cls(_frame(spark, rows, schema), True)

    @classmethod
    def table(cls, spark: SparkSession, heading: Mapping[str, object], *rows: Sequence[object]) -> Relation:
        """Literal of values in the heading's order; a repeated tuple is an error."""
        for r in rows:
            if len(r) != len(heading):
                raise E.WrongAttributes(f"{len(r)} values for {len(heading)} attributes")
        return cls.create(spark, heading, *(dict(zip(heading, r)) for r in rows))

    @classmethod
    def from_list(cls, spark: SparkSession, values: Sequence[object], attr: str, kind: object) -> Relation:
        """Unary relation; repeated values count once."""
        schema = struct_type({attr: kind})
        return cls(_frame(spark, [(coerce(v, schema[0].dataType, attr),) for v in values], schema))

    @classmethod
    def from_dict(cls, spark: SparkSession, values: Mapping, kattr: str, ktype: object, vattr: str, vtype: object) -> Relation:
        return cls.table(spark, {kattr: ktype, vattr: vtype}, *values.items())

    @classmethod
    def parse(cls, spark: SparkSession, text: str) -> Relation:
        """A relation from its text form: {attr type ...} {{attr value ...} ...}."""
        return cls.create(spark, *parsed(text))

    def text(self) -> str:
        """The text form that parse() reads."""
        return unparsed(self._df.schema, [list(r) for r in self._whole("text").collect()])

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, keys: Sequence[Sequence[str]] = ()) -> Relation:
        """A Parquet table; without a declared key its rows are made distinct."""
        return cls(spark.read.parquet(path), keys=keys)

    @classmethod
    def dee(cls, spark: SparkSession) -> Relation:
        """No attributes, one tuple: the identity of times."""
        return cls(spark.range(1).select(), True)

    @classmethod
    def dum(cls, spark: SparkSession) -> Relation:
        """No attributes, no tuple."""
        return cls(spark.range(0).select(), True)

    def empty_of(self) -> Relation:
        return Relation(self._df.limit(0), True, self.keys)

    def insert(self, *tuples: Mapping[str, object]) -> Relation:
        """With more tuples; one that is there already is an error."""
        return self.dunion(Relation.create(self.spark, self._declared(), *tuples))

    def uinsert(self, *tuples: Mapping[str, object]) -> Relation:
        """With more tuples; those there already are ignored."""
        return reduce(Relation.union, (Relation.create(self.spark, self._declared(), t) for t in tuples), self)

    def _declared(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self._df.schema.fields}

    # Introspection

    @property
    def attributes(self) -> list[str]:
        return self._df.columns

    @property
    def heading(self) -> dict[str, str]:
        return heading_of(self._df.schema)

    @property
    def degree(self) -> int:
        return len(self._df.columns)

    def cardinality(self) -> int:
        return self._whole("cardinality").count()

    def isempty(self) -> bool:
        return self._whole("isempty").isEmpty()

    def isnotempty(self) -> bool:
        return not self.isempty()

    def issametype(self, other: Relation) -> bool:
        return self.heading == other.heading

    def _has(self, *names: str) -> None:
        for n in names:
            if n not in self._df.columns:
                raise E.UnknownAttribute(n)

    def _free(self, name: str, among: Sequence[str] | None = None) -> None:
        if name in (self._df.columns if among is None else among):
            raise E.DuplicateAttribute(name)

    def _keys_within(self, names: Sequence[str]) -> list[frozenset]:
        return [k for k in self.keys if k <= set(names)]

    # Unary operators

    def restrict(self, condition: Column | str) -> Relation:
        """Tuples for which the condition holds."""
        return Relation(self._df.filter(condition), self.is_set, self.keys)

    restrictwith = restrict

    def project(self, *attrs: str) -> Relation:
        """Only these attributes; repeated names count once."""
        attrs = tuple(dict.fromkeys(attrs))
        self._has(*attrs)
        keys = self._keys_within(attrs)
        return Relation(self._df.select(*map(quoted, attrs)), bool(keys) or (self.is_set and len(attrs) == self.degree), keys)

    def eliminate(self, *attrs: str) -> Relation:
        """All attributes but these."""
        self._has(*attrs)
        return self.project(*(a for a in self.attributes if a not in attrs))

    def rename(self, *pairs: tuple[str, str], **named: str) -> Relation:
        """Pairs (old, new), one after the other; later pairs see earlier names."""
        names, now = list(self.attributes), {n: n for n in self.attributes}
        for old, new in (*pairs, *named.items()):
            if old not in names:
                raise E.UnknownAttribute(old)
            if new in names and new != old:
                raise E.DuplicateAttribute(new)
            names[names.index(old)] = new
            origin = next(k for k, v in now.items() if v == old)
            now[origin] = new
        return Relation(self._df.toDF(*names), self.is_set, [{now[a] for a in k} for k in self.keys])

    def extend(self, *triples: tuple[str, object, Column | str]) -> Relation:
        """Add (attribute, type, expression); every expression sees the original tuple."""
        new = []
        for name, kind, value in triples:
            self._free(name, [*self.attributes, *(n for n, _ in new)])
            column = F.expr(value) if isinstance(value, str) else value
            new.append((name, column.cast(data_type(kind))))
        # Inside a struct no expression can refer to another one's name.
        both = self._df.select("*", F.struct(*(c.alias(f"c{i}") for i, (_, c) in enumerate(new))).alias("_new")) if new else self._df
        df = both.select(*map(quoted, self.attributes), *(F.col(f"_new.c{i}").alias(n) for i, (n, _) in enumerate(new)))
        return Relation(df, self.is_set, self.keys)

    def update(self, condition: Column | str, values: Mapping[str, Column | str]) -> Relation:
        """Tuples where the condition holds get new values; equal tuples become one."""
        self._has(*values)
        test = F.expr(condition) if isinstance(condition, str) else condition
        kinds = self._declared()
        pick = lambda a: F.when(test, (F.expr(values[a]) if isinstance(values[a], str) else values[a]).cast(kinds[a])).otherwise(quoted(a)).alias(a)
        keys = [k for k in self.keys if not k & set(values)]
        return Relation(self._df.select(*(pick(a) if a in values else quoted(a) for a in self.attributes)), bool(keys), keys)

    def rank(self, attr: str, new: str, descending: bool = False) -> Relation:
        """Add the competition rank by one attribute."""
        self._has(attr)
        self._free(new)
        return Relation(competition_rank(self._whole("rank"), attr, new, descending), True, self.keys)

    def tag(self, new: str, ascending: Sequence[str] = (), descending: Sequence[str] = (), within: Sequence[str] = (), start: int = 0) -> Relation:
        """Add consecutive numbers in an order, per group if within is given."""
        if ascending and descending:
            raise E.AlgebraError("one direction for all attributes")
        order = [*ascending, *descending]
        self._has(*order, *within)
        self._free(new)
        keys = [*self.keys, {new, *within}]
        return Relation(tagged(self._whole("tag"), new, order, bool(descending), list(within), start), True, keys)

    def top(self, attr: str, n: int, descending: bool = True) -> Relation:
        """Tuples whose competition rank is at most n.

        The n-th value in order is found by partial heaps and compared with
        every tuple; nothing is ranked.
        """
        self._has(attr)
        df, value = self._whole("top"), quoted(attr)
        nth = df.select(value.alias("_v")).orderBy(F.desc("_v") if descending else F.asc("_v")).limit(n)
        nth = nth.agg((F.min if descending else F.max)("_v").alias("_v"))  # one row
        return Relation(df.join(F.broadcast(nth), value >= F.col("_v") if descending else value <= F.col("_v")).drop("_v"), True, self.keys)

    def group(self, new: str, *attrs: str) -> Relation:
        """Nest attributes into a relation-valued one."""
        self._has(*attrs)
        rest = [a for a in self.attributes if a not in attrs]
        if not rest or not attrs:
            raise E.BadGrouping("not all attributes, nor none")
        self._free(new, rest)
        nested = canonical(F.collect_set(nested_tuple(list(attrs))))
        return Relation(self._whole("group").groupBy(*map(quoted, rest)).agg(nested.alias(new)), True, [rest])

    def ungroup(self, attr: str) -> Relation:
        """Unnest a relation-valued attribute; tuples with an empty one vanish."""
        self._has(attr)
        kind = self._df.schema[attr].dataType
        if not is_relation(kind):
            raise E.NotNested(attr)
        rest = [a for a in self.attributes if a != attr]
        for f in kind.elementType.fields:
            self._free(f.name, rest)
        df = self._whole("ungroup").select(*map(quoted, rest), F.inline(quoted(attr)))
        return Relation(df)

    def wrap(self, new: str, *attrs: str) -> Relation:
        """Nest attributes into a tuple-valued one."""
        self._has(*attrs)
        rest = [a for a in self.attributes if a not in attrs]
        self._free(new, rest)
        keys = [k for k in self.keys if not k & set(attrs)]
        return Relation(self._df.select(*map(quoted, rest), nested_tuple(list(attrs)).alias(new)), self.is_set, keys)

    def unwrap(self, attr: str) -> Relation:
        """Flatten a tuple-valued attribute by one level."""
        self._has(attr)
        kind = self._df.schema[attr].dataType
        if not is_tuple(kind):
            raise E.NotNested(attr)
        rest = [a for a in self.attributes if a != attr]
        for f in kind.fields:
            self._free(f.name, rest)
        inner = [quoted(attr).getField(f.name).alias(f.name) for f in kind.fields]
        return Relation(self._df.select(*map(quoted, rest), *inner), self.is_set, [k for k in self.keys if attr not in k])

    def tclose(self) -> Relation:
        """Transitive closure of a binary relation."""
        kinds = [plain(f.dataType) for f in self._df.schema.fields]
        if len(kinds) != 2 or kinds[0] != kinds[1]:
            raise E.NotBinary(self.heading)
        return Relation(transitive_closure(self._whole("tclose").toDF("u", "v")).toDF(*self.attributes), True)

    # Joins

    def _pairs(self, other: Relation, using: Using) -> list[tuple[str, str]]:
        """Attribute pairs to join on: those given, or equal in name and type."""
        if using is None:
            mine, theirs = self.heading, other.heading
            return [(a, a) for a in self.attributes if theirs.get(a) == mine[a]]
        if len(set(using.values())) < len(using):
            raise E.DuplicateAttribute(list(using.values()))
        self._has(*using)
        other._has(*using.values())
        for a, b in using.items():
            if self.heading[a] != other.heading[b]:
                raise E.TypeMismatch(f"{a} and {b}")
        return list(using.items())

    def _sides(self, other: Relation, using: Using, operator: str) -> tuple[DataFrame, DataFrame, Column | None, list[tuple[str, str]]]:
        """Both sides, the right one's columns renamed to _r0, _r1, ..., and the condition."""
        pairs = self._pairs(other, using)
        left, right = self._whole(operator), other._whole(operator)
        right = right.toDF(*(f"_r{i}" for i in range(other.degree)))
        tests = [quoted(a) == F.col(f"_r{other.attributes.index(b)}") for a, b in pairs]
        return left, right, reduce(Column.__and__, tests) if tests else None, pairs

    def join(self, *others: Relation, using: Using = None) -> Relation:
        """Equi-join on attributes equal in name and type, or on those given."""
        return reduce(lambda a, b: a._join(b, using), others, self)

    def _join(self, other: Relation, using: Using) -> Relation:
        left, right, on, pairs = self._sides(other, using, "join")
        dropped = {b for _, b in pairs}
        extra = [b for b in other.attributes if b not in dropped]
        for b in extra:
            self._free(b)
        both = left.join(right, on, "inner") if on is not None else left.crossJoin(right)
        df = both.select(*map(quoted, self.attributes), *(F.col(f"_r{other.attributes.index(b)}").alias(b) for b in extra))
        back = {b: a for a, b in pairs}
        theirs = [{back.get(x, x) for x in k} for k in other.keys]
        keys: list = []
        if any(k <= dropped for k in other.keys):
            keys += self.keys
        if any(k <= {a for a, _ in pairs} for k in self.keys):
            keys += theirs
        keys = keys or [k | j for k in self.keys for j in theirs]
        return Relation(df, True, keys)

    def compose(self, *others: Relation, using: Using = None) -> Relation:
        """Join, then eliminate the join attributes of both sides."""

        def once(a: Relation, b: Relation) -> Relation:
            left, right, on, pairs = a._sides(b, using, "compose")
            mine = [x for x in a.attributes if x not in {p for p, _ in pairs}]
            theirs = [x for x in b.attributes if x not in {q for _, q in pairs}]
            for x in theirs:
                a._free(x, mine)
            both = left.join(right, on, "inner") if on is not None else left.crossJoin(right)
            return Relation(both.select(*map(quoted, mine), *(F.col(f"_r{b.attributes.index(x)}").alias(x) for x in theirs)))

        return reduce(once, others, self)

    def theta_join(self, other: Relation, condition: Column | str) -> Relation:
        """Pairs of tuples for which the condition holds; headings are disjoint."""
        self._disjoint(other)
        test = F.expr(condition) if isinstance(condition, str) else condition
        df = self._whole("theta_join").join(other._whole("theta_join"), test, "inner")
        return Relation(df, True, [k | j for k in self.keys for j in other.keys])

    def _exists(self, other: Relation, using: Using, kind: str) -> Relation:
        """Tuples of other with (or without) a match in self."""
        flipped = None if using is None else {b: a for a, b in self._pairs(other, using)}
        left, right, on, _ = other._sides(self, flipped, kind)
        return Relation(left.join(right, F.lit(True) if on is None else on, kind), True, other.keys)

    def semijoin(self, *others: Relation, using: Using = None) -> Relation:
        """Tuples of the other relation that match one of this; from left to right."""
        return reduce(lambda a, b: a._exists(b, using, "left_semi"), others, self)

    def semiminus(self, *others: Relation, using: Using = None) -> Relation:
        """Tuples of the other relation that match none of this; from left to right."""
        return reduce(lambda a, b: a._exists(b, using, "left_anti"), others, self)

    def select_related(self, *steps: tuple[Relation, Using]) -> Relation:
        """Chain of semijoins, each with its own attribute pairs."""
        return reduce(lambda a, s: a.semijoin(s[0], using=s[1]), steps, self)

    def _disjoint(self, other: Relation) -> None:
        common = set(self.attributes) & set(other.attributes)
        if common:
            raise E.NotDisjoint(sorted(common))

    def times(self, *others: Relation) -> Relation:
        """All pairs of tuples; headings are disjoint."""

        def once(a: Relation, b: Relation) -> Relation:
            a._disjoint(b)
            return Relation(a._whole("times").crossJoin(b._whole("times")), True, [k | j for k in a.keys for j in b.keys])

        return reduce(once, others, self)

    def divide(self, divisor: Relation, mediator: Relation) -> Relation:
        """Tuples that the mediator pairs with every tuple of the divisor.

        Counts the pairs of each tuple that lie in the divisor, and compares
        with the divisor's cardinality: no product is built. An empty divisor
        gives all tuples.
        """
        self._disjoint(divisor)
        if mediator.heading != {**self.heading, **divisor.heading}:
            raise E.NotUnion(mediator.heading)
        mine, med = self._whole("divide"), mediator._whole("divide")
        pairs = med.join(divisor.df, divisor.attributes, "left_semi") if divisor.attributes else med
        found = pairs.groupBy(*map(quoted, self.attributes)).agg(F.count(F.lit(1)).alias("_found"))
        needed = divisor.df.agg(F.count(F.lit(1)).alias("_needed"))
        counted = mine.join(found, self.attributes, "left") if self.attributes else mine.crossJoin(found)
        enough = F.coalesce(F.col("_found"), F.lit(0)) == F.col("_needed")
        df = counted.crossJoin(F.broadcast(needed)).filter(enough).select(*map(quoted, self.attributes))  # needed is one row
        return Relation(df, True, self.keys)

    def rvajoin(self, other: Relation, new: str, using: Using = None) -> Relation:
        """Every tuple, with the matching parts of other nested in a new attribute."""
        self._free(new)
        left, right, on, pairs = self._sides(other, using, "rvajoin")
        dropped = [b for _, b in pairs]
        extra = sorted(b for b in other.attributes if b not in dropped)
        keys = [f"_r{other.attributes.index(b)}" for b in dropped]
        nested = F.struct(*(F.col(f"_r{other.attributes.index(b)}").alias(b) for b in extra)) if extra else F.expr("named_struct()")
        groups = right.groupBy(*keys).agg(canonical(F.collect_set(nested)).alias(new))
        both = left.join(groups, on, "left") if on is not None else left.join(groups, F.lit(True), "left")
        none = F.array().cast(groups.schema[new].dataType)
        return Relation(both.select(*map(quoted, self.attributes), F.coalesce(quoted(new), none).alias(new)), True, self.keys)

    # Set operators

    def _aligned(self, other: Relation, operator: str) -> DataFrame:
        same_heading(self._df.schema, other._df.schema)
        return whole(other._df, operator).select(*map(quoted, self.attributes))

    def union(self, *others: Relation) -> Relation:
        df = reduce(lambda a, b: a.union(self._aligned(b, "union")), others, whole(self._df, "union"))
        return Relation(df, self.is_set and not others)

    def dunion(self, *others: Relation) -> Relation:
        """Union of relations without a common tuple; a common one is an error (checked at once)."""

        def once(a: Relation, b: Relation) -> Relation:
            shared = a.intersect(b).df.limit(1).collect()
            if shared:
                raise E.DuplicateTuple(shared[0].asDict())
            return Relation(a._whole("dunion").union(Relation(a._aligned(b, "dunion"), b.is_set).df), True)

        return reduce(once, others, self)

    def intersect(self, *others: Relation) -> Relation:
        df = reduce(lambda a, b: a.intersect(self._aligned(b, "intersect")), others, self._whole("intersect"))
        return Relation(df, True, self.keys)

    def minus(self, other: Relation) -> Relation:
        return Relation(self._whole("minus").subtract(self._aligned(other, "minus")), True, self.keys)

    # Comparisons

    def _counts(self, other: Relation) -> tuple[int, int, int]:
        """Tuples here, there, and in both: one job."""
        mine, theirs = self._whole("is"), Relation(self._aligned(other, "is"), other.is_set).df
        both = mine.withColumn("_s", F.lit(1)).union(theirs.withColumn("_s", F.lit(2)))
        sides = both.groupBy(*map(quoted, self.attributes)).agg(F.sum("_s").alias("_s"))
        n = {r._s: r.n for r in sides.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).collect()}
        return n.get(1, 0) + n.get(3, 0), n.get(2, 0) + n.get(3, 0), n.get(3, 0)

    def is_equal(self, other: Relation) -> bool:
        a, b, both = self._counts(other)
        return a == b == both

    def is_notequal(self, other: Relation) -> bool:
        return not self.is_equal(other)

    def is_subsetof(self, other: Relation) -> bool:
        a, _, both = self._counts(other)
        return a == both

    def is_propersubsetof(self, other: Relation) -> bool:
        a, b, both = self._counts(other)
        return a == both < b

    def is_supersetof(self, other: Relation) -> bool:
        return other.is_subsetof(self)

    def is_propersupersetof(self, other: Relation) -> bool:
        return other.is_propersubsetof(self)

    def compare(self, operator: str, other: Relation) -> bool:
        """By name or sign: equal ==, notequal !=, subsetof <=, propersubsetof <, supersetof >=, propersupersetof >."""
        signs = {"==": "equal", "!=": "notequal", "<=": "subsetof", "<": "propersubsetof", ">=": "supersetof", ">": "propersupersetof"}
        return getattr(self, f"is_{signs.get(operator, operator)}")(other)

    def contains(self, other: Relation) -> DataFrame:
        """One row of booleans, lazily: equal, subsetof, supersetof."""
        mine = self._whole("is").withColumn("_s", F.lit(1))
        theirs = Relation(self._aligned(other, "is"), other.is_set).df.withColumn("_s", F.lit(2))
        sides = mine.union(theirs).groupBy(*map(quoted, self.attributes)).agg(F.sum("_s").alias("_s"))
        only = sides.agg(F.count_if(F.col("_s") == 1).alias("a"), F.count_if(F.col("_s") == 2).alias("b"))
        return only.select(((F.col("a") == 0) & (F.col("b") == 0)).alias("is_equal"), (F.col("a") == 0).alias("is_subsetof"), (F.col("b") == 0).alias("is_supersetof"))

    # Aggregation

    def _aggregates(self, triples: Sequence[tuple[str, object, Aggregate]]) -> list[Column]:
        kinds = self._declared()
        out = []
        for name, kind, agg in triples:
            if agg.attribute is not None:
                self._has(agg.attribute)
            column = agg.build(kinds.get(agg.attribute) if agg.attribute else None)
            out.append((column if kind is None else column.cast(data_type(kind))).alias(name))
        return out

    def summarize(self, per: Relation, *triples: tuple[str, object, Aggregate]) -> Relation:
        """Tuples of per, with aggregates over the matching tuples; also where there are none."""
        for a in per.attributes:
            if self.heading.get(a) != per.heading[a]:
                raise E.NotProjection(a)
        for name, _, _ in triples:
            self._free(name, per.attributes)
        names = per.attributes
        groups = self._whole("summarize").groupBy(*map(quoted, names)).agg(*self._aggregates(triples))
        if not names:
            return Relation(per.df.crossJoin(F.broadcast(groups)), True)  # both have at most one row
        renamed = groups.toDF(*(f"_g{i}" for i in range(len(names))), *(n for n, _, _ in triples)).withColumn("_hit", F.lit(True))
        on = reduce(Column.__and__, (quoted(n) == F.col(f"_g{i}") for i, n in enumerate(names)))
        both = per._whole("summarize").join(renamed, on, "left")

        def filled(name: str, agg: Aggregate) -> Column:
            if agg.empty is None:
                return F.when(F.col("_hit"), quoted(name)).otherwise(F.raise_error(F.lit(f"{name}: no value over no tuples")).cast(groups.schema[name].dataType)).alias(name)
            none = F.array() if agg.empty == [] else F.lit(agg.empty)
            return F.coalesce(quoted(name), none.cast(groups.schema[name].dataType)).alias(name)

        return Relation(both.select(*map(quoted, names), *(filled(n, a) for n, _, a in triples)), True, [names])

    def summarizeby(self, attrs: Sequence[str], *triples: tuple[str, object, Aggregate]) -> Relation:
        """Aggregates per distinct value of attrs; no attrs over no tuples gives none."""
        self._has(*attrs)
        for name, _, _ in triples:
            self._free(name, list(attrs))
        df = self._whole("summarizeby")
        if attrs:
            return Relation(df.groupBy(*map(quoted, attrs)).agg(*self._aggregates(triples)), True, [attrs])
        counted = df.agg(*self._aggregates(triples), F.count(F.lit(1)).alias("_n"))
        return Relation(counted.filter("_n > 0").drop("_n"), True)

    def crosstab(self, cross: str, *attrs: str, most: int = 10_000) -> Relation:
        """Counts per distinct value of cross as attributes, and Total.

        More than `most` values are an error: each is an attribute of the plan.
        """
        self._has(cross, *attrs)
        df = self._whole("crosstab")
        values = sorted(r[0] for r in df.select(quoted(cross)).distinct().limit(most + 1).collect())
        if len(values) > most:
            raise E.WrongAttributes(f"more than {most} values of {cross}")
        counts = [F.count_if(quoted(cross) == F.lit(v)).cast("int").alias(str(v)) for v in values]
        total = F.count(F.lit(1)).cast("int").alias("Total")
        for v in values:
            self._free(str(v), [*attrs, "Total"])
        out = df.groupBy(*map(quoted, attrs)).agg(*counts, total) if attrs else df.agg(*counts, total).filter("Total > 0")
        return Relation(out, True, [attrs] if attrs else ())

    # Values for the host program

    def _ordered(self, ascending: Sequence[str], descending: Sequence[str]) -> DataFrame:
        self._has(*ascending, *descending)
        keys = [quoted(a).asc() for a in ascending] + [quoted(a).desc() for a in descending]
        return self._whole("list").orderBy(*keys) if keys else self._whole("list")

    def to_list(self, attr: str | None = None, ascending: Sequence[str] = (), descending: Sequence[str] = ()) -> list:
        """Values of one attribute, one for each tuple."""
        if attr is None:
            if self.degree != 1:
                raise E.WrongAttributes("one attribute has to be named")
            attr = self.attributes[0]
        self._has(attr)
        return [r[0] for r in self._ordered(ascending, descending).select(quoted(attr)).collect()]

    def to_dict(self, key: str, value: str) -> dict:
        """Mapping of one attribute to another; of a repeated key any value wins."""
        self._has(key, value)
        return {r[0]: r[1] for r in self._whole("dict").select(quoted(key).alias("k"), quoted(value).alias("v")).collect()}

    to_array = to_dict

    def body(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self._whole("body").collect()]

    def tuple(self) -> Row:
        """The only tuple."""
        rows = self._whole("tuple").limit(2).collect()
        if len(rows) != 1:
            raise E.NotOneTuple("more than one" if rows else "none")
        return rows[0]

    def extract(self, *attrs: str):
        """Values of the only tuple; a single one by itself."""
        self._has(*attrs)
        row = self.tuple()
        values = tuple(row[a] for a in attrs)
        return values[0] if len(values) == 1 else values

    def assign(self, *attrs: str | tuple[str, str]) -> dict:
        """Attributes of the only tuple by name, or by the variable name given."""
        pairs = [(a, a) if isinstance(a, str) else a for a in attrs or self.attributes]
        self._has(*(a for a, _ in pairs))
        row = self.tuple()
        return {v: row[a] for a, v in pairs}

    def foreach(self, visit: Callable[[Relation], object], ascending: Sequence[str] = (), descending: Sequence[str] = ()) -> None:
        """Call visit with a one-tuple relation for each tuple; StopIteration ends the loop."""
        for r in self.rows(ascending, descending):
            try:
                visit(Relation(_frame(self.spark, [r], self._df.schema), True))
            except StopIteration:
                return

    def flat_map(self, rows: Callable[[dict], Iterator[Mapping] | list], heading: Mapping[str, object]) -> Relation:
        """A table function of the host language: the tuples that rows(tuple) gives for each tuple.

        Runs over Arrow batches on the executors; equal tuples become one.
        """
        schema = struct_type(heading)

        def run(batches):
            import pandas as pd

            for batch in batches:
                out = [t for r in batch.to_dict("records") for t in rows(r)]
                yield pd.DataFrame(out, columns=schema.names)

        return Relation(self._whole("flat_map").mapInPandas(run, schema))

    def rows(self, ascending: Sequence[str] = (), descending: Sequence[str] = ()) -> Iterator[Row]:
        return self._ordered(ascending, descending).toLocalIterator()

    def pipe(self, *steps: Callable[[Relation], Relation]) -> Relation:
        """Steps applied from left to right."""
        return reduce(lambda r, f: f(r), steps, self)

    def __repr__(self) -> str:
        return f"Relation({self.heading})"


def _frame(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    if not schema.fields:
        return spark.range(min(len(rows), 1)).select()
    return spark.createDataFrame(rows, schema)


def cardinality_triple(name: str = "n") -> tuple[str, str, Aggregate]:
    """(name, "int", rcount()), the most usual aggregate."""
    return name, "int", rcount()
