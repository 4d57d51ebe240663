"""Relvars: identifiers, transactions, constraints, traces, stores."""

import pytest
from pyspark.sql import functions as F

from tuplewise import errors as E
from tuplewise.catalog import Catalog, attribute_constraint, system_ids
from tuplewise.relation import Relation
from tuplewise.sources import store


@pytest.fixture
def cat(spark):
    c = Catalog(spark)
    c.create("DEPT", {"d": "int", "name": "string"}, ["d"], ["name"])
    c.create("EMP", {"e": "int", "d": "int"}, ["e"])
    c.insert("DEPT", {"d": 1, "name": "a"}, {"d": 2, "name": "b"})
    c.insert("EMP", {"e": 1, "d": 1}, {"e": 2, "d": 2})
    return c


def test_definition(spark, cat):
    assert cat.names("*E*") == ["DEPT", "EMP"]
    assert cat.identifiers("DEPT") == [("d",), ("name",)]
    for ids, error in (([], E.BadIdentifier), ([["d", "d"]], E.BadIdentifier), ([["d"], ["d", "name"]], E.BadIdentifier), ([["x"]], E.UnknownAttribute)):
        with pytest.raises(error):
            cat.create("X", {"d": "int", "name": "string"}, *ids)
    with pytest.raises(E.DuplicateName):
        cat.create("EMP", {"e": "int"}, ["e"])
    with cat.transaction(), pytest.raises(E.InTransaction):
        cat.create("X", {"e": "int"}, ["e"])
    cat.unset("EMP")
    assert not cat.exists("EMP")


def test_identifiers_are_checked(cat):
    with pytest.raises(E.IdentifierViolation):
        cat.insert("DEPT", {"d": 3, "name": "a"})
    assert cat["DEPT"].cardinality() == 2
    added = cat.uinsert("DEPT", {"d": 3, "name": "a"}, {"d": 4, "name": "c"})
    assert added.to_list("d") == [4]
    assert cat.update("DEPT", "true", {"d": "d + 1"}).cardinality() == 3


def test_statements(spark, cat):
    assert cat.delete("DEPT", "d > 5") == 0
    assert cat.deleteone("DEPT", {"d": 2}) == 1
    with pytest.raises(E.NotIdentifier):
        cat.deleteone("EMP", {"d": 2})
    assert cat.updateone("EMP", {"e": 1}, {"d": "9"}).body() == [{"e": 1, "d": 9}]
    per = Relation.table(spark, {"e": "int", "d": "int"}, (2, 7), (5, 8))
    assert cat.updateper("EMP", per).body() == [{"e": 2, "d": 7}]
    assert cat.restrictone("EMP", {"e": 2}).extract("d") == 7
    assert cat.union("EMP", Relation.table(spark, {"e": "int", "d": "int"}, (3, 3))).cardinality() == 3
    assert cat.minus("EMP", Relation.table(spark, {"e": "int", "d": "int"}, (3, 3))).cardinality() == 2
    with pytest.raises(E.HeadingMismatch):
        cat.set("EMP", Relation.table(spark, {"e": "int"}, (3,)))


def test_transactions(cat):
    with pytest.raises(ZeroDivisionError), cat.transaction():
        cat.delete("EMP", "true")
        1 / 0
    assert cat["EMP"].cardinality() == 2
    cat.begin()
    with cat.transaction():
        cat.delete("EMP", "e = 1")
    cat.rollback()
    assert cat["EMP"].cardinality() == 2
    with pytest.raises(E.NoTransaction):
        cat.end()


def test_association(cat):
    cat.association("R1", "EMP", ["d"], "+", "DEPT", ["d"], "1")
    for bad in (lambda: cat.insert("EMP", {"e": 3, "d": 9}), lambda: cat.delete("EMP", "e = 1"), lambda: cat.delete("DEPT", "d = 1")):
        with pytest.raises(E.ConstraintViolation):
            bad()
    with cat.transaction():
        cat.insert("DEPT", {"d": 3, "name": "c"})
        cat.insert("EMP", {"e": 3, "d": 3})
    assert cat.constraint_member("EMP") == ["R1"] and cat.constraint_info("R1")["spec"] == "+"
    with pytest.raises(E.HasConstraints):
        cat.unset("EMP")
    with pytest.raises(E.NotIdentifier):
        cat.association("R2", "DEPT", ["d"], "*", "EMP", ["d"], "1")
    with pytest.raises(E.BadMultiplicity):
        cat.association("R2", "EMP", ["d"], "*", "DEPT", ["d"], "+")
    cat.constraint_delete("R1")
    assert cat.constraint_names() == []


def test_partition_correlation_procedural(spark):
    c = Catalog(spark)
    for n in ("LAMP", "FLOOR", "TABLE"):
        c.create(n, {"m": "int"}, ["m"])
    c.partition("P1", "LAMP", ["m"], ("FLOOR", ["m"]), ("TABLE", ["m"]))
    with c.transaction():
        c.insert("LAMP", {"m": 1}, {"m": 2})
        c.insert("FLOOR", {"m": 1})
        c.insert("TABLE", {"m": 2})
    for name, m in (("TABLE", 1), ("LAMP", 3), ("FLOOR", 4)):
        with pytest.raises(E.ConstraintViolation):
            c.insert(name, {"m": m})
    c.create("PAIR", {"x": "int", "y": "int"}, ["x", "y"])
    c.correlation("C1", "PAIR", ["x"], "*", "LAMP", ["m"], ["y"], "*", "TABLE", ["m"])
    c.insert("PAIR", {"x": 1, "y": 2})
    with pytest.raises(E.ConstraintViolation):
        c.correlation("C2", "PAIR", ["x"], "*", "LAMP", ["m"], ["y"], "*", "TABLE", ["m"], complete=True)
    c.insert("PAIR", {"x": 2, "y": 2})
    c.correlation("C2", "PAIR", ["x"], "*", "LAMP", ["m"], ["y"], "*", "TABLE", ["m"], complete=True)
    c.procedural("Q", ["PAIR"], lambda k: k["PAIR"].cardinality() < 3)
    with pytest.raises(E.ConstraintViolation):
        c.delete("PAIR", "x = 1")


def test_conditional_reference(spark):
    c = Catalog(spark)
    c.create("A", {"id": "string", "ref": "string"}, ["id"])
    c.create("B", {"id": "string"}, ["id"])
    c.association("R", "A", ["ref"], "*", "B", ["id"], "?")
    c.insert("B", {"id": "x"})
    c.insert("A", {"id": "1", "ref": "x"})
    with pytest.raises(E.ConstraintViolation):
        c.insert("A", {"id": "2", "ref": "y"})


def test_traces(spark, cat):
    seen = []
    up = lambda df: df.withColumn("name", F.upper("name"))
    cat.trace_add("DEPT", ["insert"], up)
    cat.trace_add("DEPT", ["delete"], lambda df: seen.append(df.count()))
    cat.insert("DEPT", {"d": 5, "name": "zz"})
    assert cat.restrictone("DEPT", {"d": 5}).extract("name") == "ZZ"
    cat.delete("DEPT", "d = 5")
    with cat.suspended_traces():
        cat.insert("DEPT", {"d": 6, "name": "yy"})
    assert seen == [1] and cat.restrictone("DEPT", {"d": 6}).extract("name") == "yy"
    cat.trace_remove("DEPT", ["insert"], up)
    assert len(cat.trace_info("DEPT")) == 1
    with pytest.raises(E.BadTrace):
        cat.trace_add("DEPT", ["look"], up)
    cat.create("T", {"id": "int", "v": "string"}, ["id"])
    system_ids(cat, "T", "id")
    cat.insert("T", {"v": "a"}, {"v": "b"})
    cat.insert("T", {"v": "c"})
    assert cat["T"].to_list("id", ascending=["id"]) == [1, 2, 3]
    attribute_constraint(cat, "T", "v < 'm'")
    with pytest.raises(E.ConstraintViolation):
        cat.insert("T", {"v": "z"})


def test_store(spark, cat, tmp_path):
    cat.association("R1", "EMP", ["d"], "+", "DEPT", ["d"], "1")
    store.save(cat, str(tmp_path / "s"))
    back = store.load(spark, str(tmp_path / "s"))
    assert back["EMP"].is_equal(cat["EMP"]) and back.constraint_names() == ["R1"] and back.identifiers("DEPT") == [("d",), ("name",)]
    with back.transaction():
        back.insert("DEPT", {"d": 8, "name": "h"})
        back.insert("EMP", {"e": 8, "d": 8})
    store.save(back, str(tmp_path / "t"))
    assert store.merge(cat, str(tmp_path / "t")) == []
    assert cat["EMP"].cardinality() == 3
    other = Catalog(spark)
    other.create("EMP", {"e": "string"}, ["e"])
    assert store.merge(other, str(tmp_path / "s"))[0] == "EMP"
    assert store.deserialize(spark, store.serialize(cat))["EMP"].is_equal(cat["EMP"])
    sql = store.sql_schema(cat)
    assert "constraint EMP_R1 foreign key (d) references DEPT (d)" in sql and "constraint DEPT_ID2 unique (name)" in sql
    scope = {"catalog": Catalog(spark)}
    exec(store.dump(cat), scope)  # noqa: S102
    assert scope["catalog"]["DEPT"].is_equal(cat["DEPT"])
    assert store.sql_name("order") == "order_K" and store.sql_name("a-b#") == "a_b_"
