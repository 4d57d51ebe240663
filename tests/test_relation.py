"""Golden results, set semantics, headings and errors of the operators."""

import pytest
from pyspark.sql import functions as F

from tuplewise import errors as E
from tuplewise.format import csv, relformat, relation2matrix, tupleformat
from tuplewise.functions.aggregates import aggregate, ravg, rcount, rsum
from tuplewise.relation import Relation
from tuplewise.tuples import Tuple

from .fixtures import boats, crews, parts, shipments, suppliers


@pytest.fixture(scope="module")
def S(spark):
    return suppliers(spark)


@pytest.fixture(scope="module")
def P(spark):
    return parts(spark)


@pytest.fixture(scope="module")
def SP(spark):
    return shipments(spark)


def values(relation, *attrs):
    return sorted(tuple(r[a] for a in attrs) if len(attrs) > 1 else r[attrs[0]] for r in relation.df.collect())


@pytest.mark.parametrize(("where", "want"), [("`P#` = 'P1'", ["S1", "S2"]), ("`P#` in ('P2', 'P4')", ["S1", "S4"]), ("true", ["S1"]), ("false", ["S1", "S2", "S3", "S4", "S5"])])
def test_divide(S, P, SP, where, want):
    assert values(S.project("S#").divide(P.restrict(where).project("P#"), SP.project("S#", "P#")), "S#") == want


def test_rank(S, P):
    assert values(P.rank("WEIGHT", "R", descending=True), "P#", "R") == [("P1", 5), ("P2", 2), ("P3", 2), ("P4", 4), ("P5", 5), ("P6", 1)]
    assert values(S.rank("STATUS", "R"), "S#", "R") == [("S1", 2), ("S2", 1), ("S3", 4), ("S4", 2), ("S5", 4)]
    assert values(P.top("WEIGHT", 2), "P#") == ["P2", "P3", "P6"]


def test_tag(S, SP):
    assert values(S.tag("T", ascending=["SNAME"]), "T", "S#") == [(0, "S5"), (1, "S3"), (2, "S4"), (3, "S2"), (4, "S1")]
    got = values(SP.tag("T", descending=["P#"], within=["S#"]), "S#", "T", "P#")
    assert [g for g in got if g[0] == "S4"] == [("S4", 0, "P5"), ("S4", 1, "P4"), ("S4", 2, "P2")]
    assert values(S.tag("T", ascending=["S#"], start=7), "T") == [7, 8, 9, 10, 11]


def test_summarize(spark, P, SP):
    assert values(SP.summarize(P.project("P#"), ("T", "int", rsum("QTY"))), "P#", "T") == [("P1", 600), ("P2", 1000), ("P3", 400), ("P4", 500), ("P5", 500), ("P6", 100)]
    assert SP.summarize(Relation.dee(spark), ("T", "int", rsum("QTY")), ("A", "int", ravg("QTY"))).extract("T", "A") == (3100, 258)
    none = SP.restrict("`P#` = 'P9'")
    assert values(none.summarize(P.project("P#"), ("N", "int", rcount())), "N") == [0] * 6
    assert none.summarizeby([], ("N", "int", rcount())).isempty()
    assert none.summarize(Relation.dee(spark), ("N", "int", rcount())).extract("N") == 0
    with pytest.raises(E.NotProjection):
        SP.summarize(P, ("N", "int", rcount()))
    assert values(SP.summarizeby(["S#"], ("M", "int", aggregate(F.max("QTY") - F.min("QTY")))), "S#", "M")[0] == ("S1", 300)


def test_floor_of_negative_mean(spark):
    r = Relation.from_list(spark, [-3, -4], "a", "int")
    assert r.summarizeby([], ("m", "int", ravg("a"))).extract("m") == -4


def test_textbook_queries(S, P, SP):
    assert values(SP.restrict("`P#` = 'P2'").semiminus(S), "S#") == ["S5"]
    assert values(SP.semiminus(S), "S#") == ["S5"]
    two = S.project("S#", "CITY").rename(("S#", "SA")).join(S.project("S#", "CITY").rename(("S#", "SB"))).restrict("SA < SB")
    assert values(two, "SA", "SB") == [("S1", "S4"), ("S2", "S3")]
    red = P.restrict("COLOR = 'Red'").project("P#").semijoin(SP, S)
    assert values(red, "SNAME") == ["Clark", "Jones", "Smith"]
    assert P.to_list("CITY", ascending=["P#"]) == ["London", "Paris", "Oslo", "London", "Paris", "London"]


def test_nesting(SP):
    nested = SP.group("PQ", "P#", "QTY")
    assert values(nested.extend(("n", "int", "size(PQ)")), "S#", "n") == [("S1", 6), ("S2", 2), ("S3", 1), ("S4", 3)]
    assert nested.ungroup("PQ").is_equal(SP)
    with pytest.raises(E.BadGrouping):
        SP.group("X", *SP.attributes)
    wrapped = SP.wrap("W", "P#", "QTY")
    assert wrapped.heading["W"] == "Tuple {P# {string} QTY {int}}"
    assert wrapped.unwrap("W").is_equal(SP)
    assert SP.wrap("W").unwrap("W").is_equal(SP)
    with pytest.raises(E.DuplicateAttribute):
        SP.rename(("QTY", "Q")).wrap("W", "Q").rename(("S#", "Q")).unwrap("W")


def test_rvajoin_and_crosstab(spark):
    D, O = boats(spark), crews(spark)
    joined = D.rvajoin(O, "Owners").extend(("n", "int", "size(Owners)"))
    assert dict(values(joined, "Boat", "n"))["Petrel"] == 0
    assert values(O.semiminus(D), "Boat") == ["Petrel"]
    assert O.crosstab("Since").body() == [{"1998": 3, "2004": 1, "2011": 1, "Total": 5}]
    assert O.crosstab("Since", "Boat").restrict("Boat = 'Tern'").body() == [{"Boat": "Tern", "1998": 2, "2004": 0, "2011": 0, "Total": 2}]


@pytest.mark.parametrize("edges", ["ab bc", "ab bc dc ac", "ab bc cd be ef eg", "ab bc ca ad db", "ab ac bd be cf cg"])
def test_closure(spark, edges):
    pairs = [tuple(e) for e in edges.split()]
    got = set(values(Relation.table(spark, {"A": "string", "B": "string"}, *pairs).tclose(), "A", "B"))
    want = set(pairs)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    assert got == want


def test_set_operators(spark, S):
    paris, london = S.restrict("CITY = 'Paris'"), S.restrict("CITY = 'London'")
    turned = london.project("CITY", "STATUS", "SNAME", "S#")
    assert values(paris.union(turned), "S#") == ["S1", "S2", "S3", "S4"]
    assert paris.union(S).is_equal(S)
    assert values(S.minus(turned), "S#") == ["S2", "S3", "S5"]
    assert S.intersect(turned).is_equal(london)
    assert paris.dunion(london).cardinality() == 4
    with pytest.raises(E.DuplicateTuple):
        S.dunion(paris)
    with pytest.raises(E.HeadingMismatch):
        S.union(S.project("S#"))
    assert [S.compare(o, paris) for o in ("==", "!=", "<=", "<", ">=", ">")] == [False, True, False, False, True, True]


def test_degree_zero(spark, S):
    dee, dum = Relation.dee(spark), Relation.dum(spark)
    assert S.times(dee).is_equal(S)
    assert S.times(dum).isempty()
    assert S.project().cardinality() == 1
    assert S.restrict("false").project().cardinality() == 0


def test_join_rules(spark, S, P, SP):
    assert S.join(SP, P).cardinality() == 6
    assert S.project("S#").join(P.project("P#")).cardinality() == 30
    with pytest.raises(E.DuplicateAttribute):
        S.join(P, using={"S#": "P#"})
    with pytest.raises(E.TypeMismatch):
        S.join(P, using={"STATUS": "P#"})
    with pytest.raises(E.NotDisjoint):
        S.times(P)
    other = Relation.table(spark, {"S#": "int"}, (1,))
    with pytest.raises(E.DuplicateAttribute):
        S.join(other)
    assert values(S.project("S#", "CITY").compose(P.project("P#", "CITY")), "S#", "P#")[:2] == [("S1", "P1"), ("S1", "P4")]


def test_projection_keeps_sets(S):
    assert values(S.project("CITY"), "CITY") == ["Athens", "London", "Paris"]
    assert values(S.eliminate("S#", "SNAME", "STATUS"), "CITY") == ["Athens", "London", "Paris"]
    assert values(S.update("CITY = 'Paris'", {"CITY": "'Rome'"}).project("CITY"), "CITY") == ["Athens", "London", "Rome"]
    with pytest.raises(E.UnknownAttribute):
        S.eliminate("X")


def test_known_keys_need_no_distinct(spark):
    keyed = Relation(spark.range(5).selectExpr("id", "id % 2 as two"), keys=[["id"]])
    plan = lambda r: r.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(keyed.project("id"))
    assert "Aggregate" in plan(keyed.project("two"))


def test_rename_chain(S):
    assert S.rename(("S#", "a"), ("a", "b")).attributes[0] == "b"
    with pytest.raises(E.DuplicateAttribute):
        S.rename(("S#", "CITY"))


def test_extend_sees_original(S):
    with pytest.raises(Exception, match="(?i)unresolved|cannot"):
        S.extend(("a", "int", "STATUS + 1"), ("b", "int", "a + 1")).df.collect()


def test_literals(spark, S):
    with pytest.raises(E.DuplicateTuple):
        Relation.table(spark, {"a": "int"}, (1,), (1,))
    with pytest.raises(E.BadValue):
        Relation.table(spark, {"a": "int"}, (20.0,))
    with pytest.raises(E.BadValue):
        Relation.table(spark, {"a": "boolean"}, (2,))
    with pytest.raises(E.UnknownType):
        Relation.table(spark, {"a": "date?"}, (1,))
    assert Relation.from_list(spark, [1, 1, 2], "a", "int").cardinality() == 2
    assert Relation.from_dict(spark, {"x": 1}, "k", "string", "v", "int").to_dict("k", "v") == {"x": 1}
    more = {"S#": "S6", "SNAME": "X", "STATUS": 1, "CITY": "Y"}
    assert S.insert(more).cardinality() == S.uinsert(more, more).cardinality() == 6
    with pytest.raises(E.DuplicateTuple):
        S.insert(S.body()[0])
    people = Relation.create(spark, {"n": "string", "phones": ("Relation", {"t": "string", "no": "string"})}, {"n": "a", "phones": [{"t": "x", "no": "1"}, {"t": "x", "no": "1"}]})
    assert people.ungroup("phones").body() == [{"n": "a", "no": "1", "t": "x"}]
    assert S.empty_of().isempty()


def test_values_for_the_host(spark, S):
    one = S.restrict("`S#` = 'S1'")
    assert one.extract("SNAME") == "Smith"
    assert one.assign("SNAME", ("STATUS", "s")) == {"SNAME": "Smith", "s": 20}
    with pytest.raises(E.NotOneTuple):
        S.tuple()
    seen = []
    S.foreach(lambda r: seen.append(r.extract("S#")), descending=["SNAME"])
    assert seen == ["S1", "S2", "S4", "S3", "S5"]
    assert S.pipe(lambda r: r.restrict("STATUS = 10"), lambda r: r.project("S#")).to_list() == ["S2"]


def test_relformat(S, SP):
    assert relformat(S, "Suppliers", "SNAME").split("\n")[:5] == ["+------+------+------+------+", "|S#    |SNAME |STATUS|CITY  |", "|string|string|int   |string|", "+------+------+------+------+", "|S5    |Adams |30    |Athens|"]
    assert relformat(S, "Suppliers").endswith("+\nSuppliers\n---------")
    nested = relformat(SP.group("PQ", "P#", "QTY"), "", "S#").split("\n")
    assert nested[:7] == ["+------+------------+", "|S#    |PQ          |", "|string|Relation    |", "+------+------------+", "|S1    |+------+---+|", "|      ||P#    |QTY||", "|      ||string|int||"]
    assert csv(S.project("S#", "STATUS"), ["S#"]).split("\n")[:3] == ["S#,STATUS", "string,int", "S1,20"]
    assert relation2matrix(S.project("S#"), ["S#"], heading=False)[0] == ["S1"]


def test_tuples(spark):
    t = Tuple({"a": "int", "b": "string"}, {"a": 1, "b": "x"})
    assert t.extend(("c", "double", 2)).extract("c") == 2.0
    assert t.rename(("a", "z")).attributes == ["z", "b"]
    assert t.wrap("w", "a", "b").unwrap("w").equal(t)
    assert t.update(a=5).project("a").get() == {"a": 5}
    assert t == Tuple.from_list({"b": "string", "a": "int"}, ["x", 1])
    assert t.relation(spark).body() == [{"a": 1, "b": "x"}]
    assert tupleformat(t).split("\n")[1] == "|a  |b     |"
    with pytest.raises(E.DuplicateAttribute):
        t.extend(("a", "int", 1))


def test_streams_are_refused(spark, tmp_path):
    stream = spark.readStream.format("rate").load()
    r = Relation(stream, True)
    assert r.restrict("value > 1").rename(("value", "v")).df.isStreaming
    with pytest.raises(E.StreamingNotSupported):
        r.project("value").df
    with pytest.raises(E.StreamingNotSupported):
        r.join(r.rename(("value", "v")))
