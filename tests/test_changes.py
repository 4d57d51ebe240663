"""Deltas of relvars, namespaces, text form, scratch tables, bounds."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tuplewise import catalog as C
from tuplewise import errors as E
from tuplewise.catalog import Catalog
from tuplewise.plans import scratch
from tuplewise.relation import Relation
from tuplewise.sources import sqlite, store


@pytest.fixture
def cat(spark):
    c = Catalog(spark)
    c.create("A", {"a": "int", "v": "string"}, ["a"])
    c.create("B", {"b": "int", "a": "int"}, ["b"])
    c.association("R", "B", ["a"], "*", "A", ["a"], "1")
    with c.transaction():
        c.insert("A", *({"a": i, "v": f"v{i}"} for i in range(5)))
        c.insert("B", *({"b": i, "a": i % 5} for i in range(8)))
    return c


def test_deltas_are_checked_against_the_rest(cat):
    for k in range(C.DELTAS + 3):
        cat.insert("B", {"b": 100 + k, "a": k % 5})
        assert cat._find("B").deltas <= C.DELTAS
    assert cat["B"].cardinality() == 8 + C.DELTAS + 3
    for bad in (lambda: cat.insert("B", {"b": 3, "a": 1}), lambda: cat.insert("B", {"b": 50, "a": 1}, {"b": 50, "a": 2}), lambda: cat.insert("B", {"b": 51, "a": 9}), lambda: cat.delete("A", "a = 1")):
        with pytest.raises((E.IdentifierViolation, E.ConstraintViolation)):
            bad()
    assert cat["A"].cardinality() == 5
    with cat.transaction():  # the final state counts
        cat.delete("B", "b = 3")
        cat.insert("B", {"b": 3, "a": 4})
    assert cat.restrictone("B", {"b": 3}).extract("a") == 4
    with cat.transaction():
        cat.delete("B", "a = 1")
        cat.delete("A", "a = 1")
    assert cat["A"].cardinality() == 4
    cat.delete("B", F.rand(3) < 0.5)
    assert cat["B"].body() == cat["B"].body()


def test_names_nest(spark, cat):
    with cat.within("one"):
        cat.create("A", {"x": "int"}, ["x"])
        assert cat.path("A") == "::one::A" and cat.path("B") == "::B" and cat["A"].degree == 1
        with cat.within("two"):
            cat.create("C", {"x": "int"}, ["x"])
    assert cat.path("::one::two::C") == "::one::two::C" and not cat.exists("C") and cat["A"].degree == 2
    assert cat.names("one::*") == ["one::A", "one::two::C"]
    back = store.deserialize(spark, store.serialize(cat))
    assert back.names() == cat.names() and back.constraint_info("R") == cat.constraint_info("R")


def test_updates_one_by_one(cat):
    seen = []
    cat.trace_add("A", ["update"], lambda df: seen.extend((r._old.v, r.v) for r in df.collect()))

    def change(row):
        if len(seen_rows) == 2:
            raise StopIteration
        seen_rows.append(row)
        return {"v": row["v"].upper()}

    seen_rows: list = []
    assert cat.update_each("A", "true", change).cardinality() == 2
    assert sorted(seen) == sorted((r["v"], r["v"].upper()) for r in seen_rows)
    assert sum(v.isupper() for v in cat["A"].to_list("v")) == 2
    assert cat.update_each("A", "a < 0", lambda r: {}).cardinality() == 0


def test_text_form(spark):
    r = Relation.table(spark, {"a": "int", "b": "string", "c": "boolean", "l": "list"}, (1, "x {y} z", True, ["p", "q r"]), (2, "", False, []))
    assert Relation.parse(spark, r.text()).is_equal(r)
    nested = r.eliminate("l").wrap("t", "b", "c").group("g", "t")
    assert Relation.parse(spark, nested.text()).is_equal(nested)
    for bad, error in (("{a int} {{a 1}", E.BadValue), ("{a int} {{b 1}}", E.WrongAttributes), ("{a int} {{a x}}", E.BadValue), ("{a}", E.WrongAttributes), ("{a int} {{a 1} {a 1}}", E.DuplicateTuple)):
        with pytest.raises(error):
            Relation.parse(spark, bad)


def test_values_survive_stores(spark, tmp_path):
    c = Catalog(spark)
    c.create("odd", {"k": "int", "s": "string", "b": "bytearray", "n": "bignum", "d": "double", "r": ("Relation", {"x": "int"})}, ["k"])
    c.insert("odd", {"k": 1, "s": "a'''b\\ \"c\" {d}\n", "b": b"\0\xff", "n": 10**30, "d": 0.5, "r": [{"x": 1}, {"x": 2}]})
    sqlite.store_to_sqlite(c, str(tmp_path / "s.db"))
    store.dump_to_file(c, str(tmp_path / "d.py"))
    store.serialize_to_file(c, str(tmp_path / "j.json"))
    scope = {"catalog": Catalog(spark)}
    exec((tmp_path / "d.py").read_text(), scope)  # noqa: S102
    for back in (sqlite.load_from_sqlite(spark, str(tmp_path / "s.db")), scope["catalog"], store.deserialize_from_file(spark, str(tmp_path / "j.json"))):
        assert back["odd"].body() == c["odd"].body()


def test_top_crosstab_and_tag(spark):
    r = Relation.table(spark, {"g": "int", "v": "int"}, *((i % 3, i // 2) for i in range(12)))
    assert sorted(r.top("v", 3).to_list("v")) == [4, 4, 5, 5] and sorted(r.top("v", 1, descending=False).to_list("v")) == [0, 0]
    assert r.top("v", 99).cardinality() == r.cardinality()
    with pytest.raises(E.WrongAttributes):
        r.crosstab("v", most=3)
    tagged = r.tag("n", ascending=["v"], within=["g"], start=5)
    for g in range(3):
        rows = sorted((t["v"], t["n"]) for t in tagged.body() if t["g"] == g)
        assert [n for _, n in rows] == list(range(5, 5 + len(rows)))


def test_scratch_tables_go_with_python(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from tuplewise.relation import Relation
r = Relation.table(spark, {{"a": "int"}}, (1,), (2,))
assert r.tag("n", ascending=["a"]).cardinality() == 2 and r.rank("a", "r").cardinality() == 2
import os
assert os.listdir({str(tmp_path / "tables")!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
    assert os.listdir(tmp_path / "tables") == []


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: {})})  # noqa: N815

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)
