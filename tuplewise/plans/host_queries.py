"""Registered queries for what ends in or starts from host values: literals, sinks, headings, relvars, traces, tuples.

A host value comes back as a small DataFrame, so that SQL can check it.
"""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, attribute_constraint, system_ids
from ..errors import AlgebraError
from ..format import csv, csv_to_file, csv_to_folder, relation2matrix, relformat, tuple2matrix, tupleformat
from ..functions.aggregates import aggregate, rfold
from ..functions.text import string_match
from ..relation import Relation
from ..sources import sqlite, store
from ..streaming.guard import STATELESS
from ..tuples import Tuple, struct_eliminate, struct_extend, struct_project, struct_rename
from .queries import _relvar, query
from .scratch import delete, shared_dir


def _frame(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _one(r: Relation, schema: str, *values) -> DataFrame:
    return _frame(r.spark, schema, values)


# Literals

_LITERALS = "SELECT * FROM (VALUES (1, 'one'), (2, 'two')) AS v(n, word)"


@query(_LITERALS)
def literal_create(t):
    return Relation.create(t("region").spark, {"n": "int", "word": "string"}, {"word": "one", "n": 1}, {"n": 2, "word": "two"})


@query(_LITERALS)
def literal_table(t):
    return Relation.table(t("region").spark, {"n": "int", "word": "string"}, (1, "one"), (2, "two"))


@query("SELECT DISTINCT n_regionkey AS k FROM nation")
def literal_fromlist(t):
    return Relation.from_list(t("region").spark, t("nation").to_list("n_regionkey"), "k", "int")


@query("SELECT n_name AS name, n_nationkey AS k FROM nation")
def literal_fromdict(t):
    return Relation.from_dict(t("region").spark, t("nation").to_dict("n_name", "n_nationkey"), "name", "string", "k", "int")


@query("SELECT * FROM nation WHERE false")
def literal_emptyof(t):
    return t("nation").empty_of()


@query("SELECT * FROM region UNION ALL SELECT 98, 'HERE' UNION ALL SELECT 99, 'THERE'")
def literal_insert(t):
    return t("region").insert({"r_regionkey": 98, "r_name": "HERE"}, {"r_regionkey": 99, "r_name": "THERE"})


@query("SELECT * FROM region UNION SELECT 99, 'THERE'")
def literal_uinsert(t):
    first = t("region").restrict("r_regionkey = 0").body()[0]
    return t("region").uinsert(first, {"r_regionkey": 99, "r_name": "THERE"})


@query("SELECT * FROM region")
def literal_parse(t):
    return Relation.parse(t("region").spark, t("region").text())


@query("SELECT n_regionkey, CAST(count(*) AS INT) AS n FROM nation GROUP BY 1")
def literal_parse_nested(t):
    nested = t("nation").group("ns", "n_nationkey", "n_name")
    back = Relation.parse(nested.spark, nested.text())
    return back.extend(("n", "int", "size(ns)")).eliminate("ns")


@query("SELECT true AS dee, false AS dum")
def dum_dee(t):
    r = t("region")
    return _one(r, "dee boolean, dum boolean", Relation.dee(r.spark).isnotempty(), Relation.dum(r.spark).isnotempty())


# Sinks

@query("SELECT n_name AS v, CAST(row_number() OVER (ORDER BY n_name DESC) AS INT) AS i FROM nation")
def sink_list(t):
    r = t("nation")
    return _frame(r.spark, "v string, i int", *((v, i) for i, v in enumerate(r.to_list("n_name", descending=["n_name"]), 1)))


@query("SELECT n_nationkey AS k, n_name AS v FROM nation")
def sink_dict(t):
    return _frame(t("nation").spark, "k int, v string", *t("nation").to_dict("n_nationkey", "n_name").items())


@query("SELECT r_name AS k, r_regionkey AS v FROM region")
def sink_array(t):
    return _frame(t("region").spark, "k string, v int", *t("region").to_array("r_name", "r_regionkey").items())


@query("SELECT * FROM region")
def sink_body(t):
    return _frame(t("region").spark, "r_regionkey int, r_name string", *((b["r_regionkey"], b["r_name"]) for b in t("region").body()))


@query("SELECT * FROM nation WHERE n_nationkey = 7")
def sink_tuple(t):
    r = t("nation").restrict("n_nationkey = 7")
    return r.spark.createDataFrame([r.tuple()], r.df.schema)


@query("SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey = 7")
def sink_extract(t):
    return _one(t("nation"), "name string, region int", *t("nation").restrict("n_nationkey = 7").extract("n_name", "n_regionkey"))


@query("SELECT n_name AS name, n_regionkey FROM nation WHERE n_nationkey = 8")
def sink_assign(t):
    found = t("nation").restrict("n_nationkey = 8").assign(("n_name", "name"), "n_regionkey")
    return _one(t("nation"), "name string, n_regionkey int", found["name"], found["n_regionkey"])


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) AS INT) AS i FROM nation QUALIFY i <= 5")
def sink_foreach(t):
    seen = []

    def visit(one: Relation) -> None:
        seen.append(one.extract("n_name"))
        if len(seen) == 5:
            raise StopIteration

    t("nation").foreach(visit, ascending=["n_name"])
    return _frame(t("nation").spark, "n_name string, i int", *((n, i) for i, n in enumerate(seen, 1)))


_BOXED = """WITH w AS (SELECT greatest(length('r_regionkey'), max(length(r_regionkey::VARCHAR))) AS a, greatest(length('r_name'), max(length(r_name))) AS b FROM region {where}),
s AS (SELECT '+' || repeat('-', CAST(a AS INT)) || '+' || repeat('-', CAST(b AS INT)) || '+' AS rule, a, b FROM w),
x AS (SELECT string_agg('|' || rpad(r_regionkey::VARCHAR, CAST(a AS INT), ' ') || '|' || rpad(r_name, CAST(b AS INT), ' ') || '|', chr(10) ORDER BY r_name) AS body FROM region, s {where})
SELECT rule || chr(10) || '|' || rpad('r_regionkey', CAST(a AS INT), ' ') || '|' || rpad('r_name', CAST(b AS INT), ' ') || '|' || chr(10) || '|' || rpad('int', CAST(a AS INT), ' ') || '|' || rpad('string', CAST(b AS INT), ' ') || '|' || chr(10) || rule || chr(10) || body || chr(10) || rule || {title} AS text FROM s, x"""


@query(_BOXED.format(where="", title="chr(10) || 'Regions' || chr(10) || '-------'"))
def sink_relformat(t):
    return _one(t("region"), "text string", relformat(t("region"), "Regions", ["r_name"]))


@query(_BOXED.format(where="WHERE r_regionkey = 3", title="''"))
def sink_tupleformat(t):
    one = Tuple({"r_regionkey": "int", "r_name": "string"}, t("region").restrict("r_regionkey = 3").body()[0])
    return _one(t("region"), "text string", tupleformat(one))


@query("SELECT * FROM (SELECT 0 AS i, 'r_regionkey' AS a, 'r_name' AS b UNION ALL SELECT 1, 'int', 'string' UNION ALL SELECT CAST(row_number() OVER (ORDER BY r_name) + 1 AS INT), r_regionkey::VARCHAR, r_name FROM region)")
def sink_relation2matrix(t):
    rows = relation2matrix(t("region"), ["r_name"])
    return _frame(t("region").spark, "i int, a string, b string", *((i, str(a), b) for i, (a, b) in enumerate(rows)))


@query("SELECT 0 AS i, 'r_regionkey' AS a, 'r_name' AS b UNION ALL SELECT 1, 'int', 'string' UNION ALL SELECT 2, '4', r_name FROM region WHERE r_regionkey = 4")
def sink_tuple2matrix(t):
    one = Tuple({"r_regionkey": "int", "r_name": "string"}, t("region").restrict("r_regionkey = 4").body()[0])
    return _frame(t("region").spark, "i int, a string, b string", *((i, str(a), b) for i, (a, b) in enumerate(tuple2matrix(one))))


_CSV = "SELECT 'r_regionkey,r_name' || chr(10) || 'int,string' || chr(10) || string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey) AS text FROM region"


@query(_CSV)
def sink_csv(t):
    return _one(t("region"), "text string", csv(t("region"), ["r_regionkey"]))


@query(_CSV)
def sink_csv_file(t):
    with tempfile.TemporaryDirectory() as folder:
        csv_to_file(t("region"), f"{folder}/region.csv", ["r_regionkey"])
        with open(f"{folder}/region.csv", encoding="utf-8") as f:
            return _one(t("region"), "text string", f.read())


@query("SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def sink_csv_folder(t):
    r = t("region")
    path = f"{shared_dir(r.spark)}/csv-{os.urandom(8).hex()}"
    csv_to_folder(r, path)
    rows = r.spark.read.csv(path, header=True).collect()
    delete(r.spark, path)
    return _frame(r.spark, "r_regionkey string, r_name string", *map(tuple, rows))


# Stores

def _world(t) -> Catalog:
    catalog = Catalog(t("region").spark)
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey")):
        value = t(name)
        catalog.create(name, {f.name: f.dataType for f in value._df.schema.fields}, [key])
        catalog.set(name, value)
    catalog.association("R1", "nation", ["n_regionkey"], "*", "region", ["r_regionkey"], "1")
    return catalog


def _with_region(catalog: Catalog) -> Relation:
    """What a store has to give back: the tuples, the reference, the identifiers."""
    assert catalog.constraint_info("R1")["to"] == "region" and catalog.identifiers("nation") == [("n_nationkey",)]
    return catalog["nation"].join(catalog["region"], using={"n_regionkey": "r_regionkey"})


_NATIONS = "SELECT nation.*, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(_NATIONS)
def store_folder(t):
    catalog = _world(t)
    path = f"{shared_dir(catalog.spark)}/store-{os.urandom(8).hex()}"
    store.save(catalog, path)
    out = _with_region(store.load(catalog.spark, path)).df.collect()
    delete(catalog.spark, path)
    return catalog.spark.createDataFrame(out, "n_nationkey int, n_name string, n_regionkey int, r_name string")


@query(_NATIONS)
def store_sqlite(t):
    catalog = _world(t)
    with tempfile.TemporaryDirectory() as folder:
        sqlite.store_to_sqlite(catalog, f"{folder}/store.db")
        return _with_region(sqlite.load_from_sqlite(catalog.spark, f"{folder}/store.db"))


@query(_NATIONS)
def store_serialize(t):
    catalog = _world(t)
    return _with_region(store.deserialize(catalog.spark, json.loads(json.dumps(store.serialize(catalog)))))


@query(_NATIONS)
def store_serialize_file(t):
    catalog = _world(t)
    with tempfile.TemporaryDirectory() as folder:
        store.serialize_to_file(catalog, f"{folder}/store.json")
        return _with_region(store.deserialize_from_file(catalog.spark, f"{folder}/store.json"))


@query(_NATIONS)
def store_dump(t):
    catalog = _world(t)
    scope = {"catalog": Catalog(catalog.spark)}
    with tempfile.TemporaryDirectory() as folder:
        store.dump_to_file(catalog, f"{folder}/store.py")
        with open(f"{folder}/store.py", encoding="utf-8") as f:
            exec(compile(f.read(), "store.py", "exec"), scope)  # noqa: S102
    return _with_region(scope["catalog"])


@query("SELECT 5 AS n, true AS reference, true AS identifier, true AS plain")
def store_sql_schema(t):
    text = store.sql_schema(_world(t))
    checks = [part in text for part in ("foreign key (n_regionkey) references region (r_regionkey)", "constraint nation_ID1 unique (n_nationkey)", "n_name text not null")]
    return _one(t("region"), "n int, reference boolean, identifier boolean, plain boolean", text.count(" not null"), *checks)


@query("SELECT 'order_K' AS word, 'a_b_' AS signs, 'plain' AS plain")
def store_sql_names(t):
    return _one(t("region"), "word string, signs string, plain string", *map(store.sql_name, ("order", "a-b#", "plain")))


def _half(t) -> tuple[Catalog, Catalog]:
    whole, part = _world(t), Catalog(t("region").spark)
    part.create("nation", {f.name: f.dataType for f in t("nation")._df.schema.fields}, ["n_nationkey"])
    part.set("nation", t("nation").restrict("n_nationkey < 9").update("true", {"n_name": "lower(n_name)"}))
    return whole, part


_MERGED = "SELECT n_nationkey, CASE WHEN n_nationkey < 9 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation"


@query(_MERGED)
def store_merge(t):
    whole, part = _half(t)
    path = f"{shared_dir(whole.spark)}/store-{os.urandom(8).hex()}"
    store.save(whole, path)
    assert store.merge(part, path) == []
    rows = part["nation"].df.collect()
    delete(whole.spark, path)
    return whole.spark.createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int")


@query(_MERGED)
def store_merge_sqlite(t):
    whole, part = _half(t)
    with tempfile.TemporaryDirectory() as folder:
        sqlite.store_to_sqlite(whole, f"{folder}/store.db")
        assert sqlite.merge_from_sqlite(part, f"{folder}/store.db") == []
    return part["nation"]


# Comparisons, cardinality, headings

_SIDES = """FROM (SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS a,
(SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS b)"""


def _customers(t):
    return t("orders").project("o_custkey").rename(("o_custkey", "k")), t("customer").project("c_custkey").rename(("c_custkey", "k"))


@query(f"SELECT a > 0 OR b > 0 AS v {_SIDES}")
def is_notequal(t):
    a, b = _customers(t)
    return _one(a, "v boolean", a.compare("!=", b))


@query(f"SELECT a = 0 AND b > 0 AS v {_SIDES}")
def is_propersubsetof(t):
    a, b = _customers(t)
    return _one(a, "v boolean", a.compare("<", b))


@query(f"SELECT b = 0 AND a > 0 AS v {_SIDES}")
def is_propersupersetof(t):
    a, b = _customers(t)
    return _one(a, "v boolean", a.compare(">", b))


@query(f"SELECT a = 0 AND b = 0 AS eq, a = 0 AS le, b = 0 AS ge, true AS self {_SIDES}")
def is_equal_and_bounds(t):
    a, b = _customers(t)
    return _one(a, "eq boolean, le boolean, ge boolean, self boolean", a.compare("==", b), a.compare("<=", b), a.compare(">=", b), a.is_equal(a))


@query("SELECT count(*) AS n, 6 AS degree FROM orders")
def cardinality_degree(t):
    return _one(t("orders"), "n long, degree int", t("orders").cardinality(), t("orders").degree)


@query("SELECT count(*) = 0 AS empty, count(*) > 0 AS notempty FROM orders WHERE o_totalprice < 0")
def isempty_isnotempty(t):
    none = t("orders").restrict("o_totalprice < 0")
    return _one(none, "empty boolean, notempty boolean", none.isempty(), none.isnotempty())


@query("SELECT 'n_nationkey,n_name,n_regionkey' AS names, 'int,string,int' AS kinds, true AS same, false AS other")
def headings(t):
    n = t("nation")
    names, kinds = ",".join(n.attributes), ",".join(n.heading.values())
    return _one(n, "names string, kinds string, same boolean, other boolean", names, kinds, n.issametype(n.project("n_name", "n_regionkey", "n_nationkey")), n.issametype(t("region")))


# Relvars

@query("SELECT * FROM region UNION ALL SELECT 98, 'HERE' UNION ALL SELECT 99, 'THERE'")
def relvar_insert(t):
    catalog = _relvar(t, "region")
    catalog.insert("region", {"r_regionkey": 98, "r_name": "HERE"}, {"r_regionkey": 99, "r_name": "THERE"})
    return catalog["region"]


@query("SELECT count(*) AS n, true AS refused FROM region")
def relvar_insert_refused(t):
    catalog = _relvar(t, "region")
    try:
        catalog.insert("region", {"r_regionkey": 1, "r_name": "TWICE"})
    except AlgebraError:
        return _one(catalog["region"], "n long, refused boolean", catalog["region"].cardinality(), True)


@query("SELECT * FROM region WHERE r_regionkey <> 3")
def relvar_deleteone(t):
    catalog = _relvar(t, "region")
    assert catalog.deleteone("region", {"r_regionkey": 3}) == 1 and catalog.deleteone("region", {"r_regionkey": 77}) == 0
    return catalog["region"]


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 3 THEN 'X' ELSE r_name END AS r_name FROM region")
def relvar_updateone(t):
    catalog = _relvar(t, "region")
    catalog.updateone("region", {"r_regionkey": 3}, {"r_name": "'X'"})
    return catalog["region"]


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (0, 1, 2) THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey FROM nation")
def relvar_update_stops(t):
    """A loop over tuples that ends early keeps what it did."""
    catalog = _relvar(t, "nation")
    done: list = []

    def change(row: dict) -> dict | None:
        if len(done) == 3:
            raise StopIteration
        if row["n_nationkey"] > 2:
            return None
        done.append(row)
        return {"n_name": row["n_name"] + "!"}

    catalog.update_each("nation", "n_nationkey < 10", change)
    return catalog["nation"]


@query("SELECT * FROM nation WHERE n_regionkey IN (0, 1) UNION SELECT * FROM nation WHERE n_regionkey = 2")
def relvar_union(t):
    catalog = _relvar(t, "nation", rows="n_regionkey < 2")
    return catalog.union("nation", t("nation").restrict("n_regionkey between 1 and 2"))


@query("SELECT * FROM nation WHERE n_regionkey IN (0, 2)")
def relvar_dunion(t):
    catalog = _relvar(t, "nation", rows="n_regionkey = 0")
    return catalog.dunion("nation", t("nation").restrict("n_regionkey = 2"))


@query("SELECT * FROM nation WHERE n_regionkey = 1")
def relvar_intersect(t):
    catalog = _relvar(t, "nation", rows="n_regionkey < 2")
    return catalog.intersect("nation", t("nation").restrict("n_regionkey > 0"))


@query("SELECT * FROM nation WHERE n_regionkey <> 2")
def relvar_minus(t):
    catalog = _relvar(t, "nation")
    return catalog.minus("nation", t("nation").restrict("n_regionkey = 2"))


@query("SELECT true AS before, false AS after, true AS held")
def relvar_unset(t):
    catalog = _world(t)
    before = catalog.exists("nation")
    try:
        catalog.unset("region")
        held = False
    except AlgebraError:
        held = True
    catalog.constraint_delete("R1")
    catalog.unset("nation")
    return _one(t("region"), "before boolean, after boolean, held boolean", before, catalog.exists("nation"), held)


@query("SELECT * FROM nation WHERE n_nationkey > 2 UNION ALL SELECT 1, 'one', 1")
def relvar_eval(t):
    catalog = _world(t)
    with catalog.eval():
        catalog.delete("nation", "n_nationkey <= 2")
        catalog.insert("nation", {"n_nationkey": 1, "n_name": "one", "n_regionkey": 1})
    return catalog["nation"]


@query("SELECT count(*) AS n, true AS refused FROM nation")
def relvar_association_refused(t):
    catalog = _world(t)
    refused = 0
    for bad in (lambda: catalog.insert("nation", {"n_nationkey": 99, "n_name": "x", "n_regionkey": 99}), lambda: catalog.delete("region", "r_regionkey = 1")):
        try:
            bad()
        except AlgebraError:
            refused += 1
    return _one(catalog["nation"], "n long, refused boolean", catalog["nation"].cardinality(), refused == 2)


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)) AS n, true AS refused")
def relvar_correlation(t):
    catalog = _world(t)
    pairs = t("supplier").project("s_nationkey").join(t("nation").project("n_nationkey", "n_regionkey"), using={"s_nationkey": "n_nationkey"})
    catalog.create("pair", {"s_nationkey": "int", "n_regionkey": "int"}, ["s_nationkey", "n_regionkey"])
    catalog.set("pair", pairs)
    catalog.correlation("C1", "pair", ["s_nationkey"], "*", "nation", ["n_nationkey"], ["n_regionkey"], "*", "region", ["r_regionkey"])
    try:
        catalog.insert("pair", {"s_nationkey": 99, "n_regionkey": 1})
    except AlgebraError:
        return _one(pairs, "n long, refused boolean", catalog["pair"].cardinality(), True)


@query("SELECT count(*) AS n, true AS refused FROM nation")
def relvar_procedural(t):
    catalog = _world(t)
    catalog.procedural("P1", ["nation"], lambda c: c["nation"].cardinality() > 20)
    try:
        catalog.delete("nation", "n_nationkey > 3")
    except AlgebraError:
        return _one(catalog["nation"], "n long, refused boolean", catalog["nation"].cardinality(), True)


@query("SELECT true AS before, 'R1' AS names, 'association' AS kind, 'nation' AS referring, 'R1' AS member, '' AS after, '' AS path")
def relvar_constraints(t):
    catalog = _world(t)
    info = catalog.constraint_info("R1")
    values = [catalog.constraint_exists("R1"), ",".join(catalog.constraint_names("R*")), info["kind"], info["referring"], ",".join(catalog.constraint_member("region"))]
    path = catalog.constraint_path("R1").removesuffix("R1")
    catalog.constraint_delete("R1")
    return _one(t("region"), "before boolean, names string, kind string, referring string, member string, after string, path string", *values, ",".join(catalog.constraint_names()), path)


@query("SELECT 'nation,region' AS names, '::nation' AS path, 'n_nationkey' AS identifiers, '::far::nation' AS inner_path, 3 AS here, 1 AS far, false AS elsewhere")
def relvar_names(t):
    catalog = _world(t)
    names = ",".join(catalog.names())
    with catalog.within("far"):
        catalog.create("nation", {"n": "int"}, ["n"])
        catalog.insert("nation", {"n": 1})
        inner, far = catalog.path("nation"), catalog["nation"].cardinality()
        here = catalog["::nation"].degree
    return _one(t("region"), "names string, path string, identifiers string, inner_path string, here int, far int, elsewhere boolean", names, catalog.path("nation"), ",".join(catalog.identifiers("nation")[0]), inner, here, far, catalog.exists("::near::nation"))


# Traces

@query("SELECT * FROM region UNION ALL SELECT 9, 'NINE'")
def trace_insert(t):
    catalog = _relvar(t, "region")
    catalog.trace_add("region", ["insert"], lambda df: df.withColumn("r_name", F.upper("r_name")))
    catalog.insert("region", {"r_regionkey": 9, "r_name": "nine"})
    return catalog["region"]


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 2")
def trace_delete(t):
    catalog, seen = _relvar(t, "region"), []
    catalog.trace_add("region", ["delete"], lambda df: seen.extend(df.collect()))
    catalog.delete("region", "r_regionkey > 2")
    return t("region").spark.createDataFrame(seen, "r_regionkey int, r_name string")


@query("SELECT r_regionkey + 10 AS r_regionkey, r_name FROM region")
def trace_set(t):
    catalog = _relvar(t, "region")
    catalog.trace_add("region", ["set"], lambda df: df.withColumn("r_regionkey", F.col("r_regionkey") + 10))
    return catalog.set("region", t("region"))


@query("SELECT 'region' AS name, false AS there")
def trace_unset(t):
    catalog, seen = _relvar(t, "region"), []
    catalog.trace_add("region", ["unset"], seen.append)
    catalog.unset("region")
    return _one(t("region"), "name string, there boolean", seen[0], catalog.exists("region"))


@query("SELECT r_regionkey AS old, r_regionkey + 100 AS new FROM region WHERE r_regionkey < 3")
def trace_update(t):
    """Both the tuple before and the one after: changed keys can be passed on to what refers to them."""
    catalog, seen = _relvar(t, "region"), []
    catalog.trace_add("region", ["update"], lambda df: seen.extend(df.select(F.col("_old.r_regionkey").alias("old"), F.col("r_regionkey").alias("new")).collect()))
    catalog.update("region", "r_regionkey < 3", {"r_regionkey": "r_regionkey + 100"})
    return t("region").spark.createDataFrame(seen, "old int, new int")


@query("SELECT * FROM (VALUES (1, 'begin', 1), (2, 'begin', 2), (3, 'end', 2), (4, 'end', 1)) AS v(i, what, level)")
def trace_transaction(t):
    catalog, seen = _relvar(t, "region"), []
    catalog.watch_transactions(lambda what, level: seen.append((what, level)))
    with catalog.transaction():
        catalog.delete("region", "r_regionkey = 1")
    return _frame(t("region").spark, "i int, what string, level int", *((i, *x) for i, x in enumerate(seen, 1)))


@query("SELECT 1 AS seen, 1 AS traces, 0 AS after")
def trace_suspend(t):
    catalog, seen = _relvar(t, "region"), []
    f = lambda df: seen.append(df.count())
    catalog.trace_add("region", ["delete"], f)
    with catalog.suspended_traces():
        catalog.delete("region", "r_regionkey = 1")
    catalog.delete("region", "r_regionkey = 2")
    traces = len(catalog.trace_info("region"))
    catalog.trace_remove("region", ["delete"], f)
    return _one(t("region"), "seen int, traces int, after int", len(seen), traces, len(catalog.trace_info("region")))


# Tuples

_TUPLE = "SELECT 1 AS id, 'Ann' AS name, 20 AS age"


def _ann() -> Tuple:
    return Tuple.from_list({"id": "int", "name": "string", "age": "int"}, [1, "Ann", 20])


@query(_TUPLE)
def tuple_create(t):
    return Tuple.create({"id": "int", "name": "string", "age": "int"}, name="Ann", id=1, age=20).relation(t("region").spark)


@query(_TUPLE)
def tuple_fromlist(t):
    return _ann().relation(t("region").spark)


@query("SELECT 'id,name,age' AS attributes, 3 AS degree, 'int,string,int' AS kinds")
def tuple_heading(t):
    return _one(t("region"), "attributes string, degree int, kinds string", ",".join(_ann().attributes), _ann().degree, ",".join(_ann().heading.values()))


@query("SELECT 'Ann' AS name, 20 AS age, 1 AS id, 'Ann' AS got")
def tuple_extract_get_assign(t):
    name, age = _ann().extract("name", "age")
    return _one(t("region"), "name string, age int, id int, got string", name, age, _ann().assign()["id"], _ann().get()["name"])


@query("SELECT true AS same, false AS other")
def tuple_equal(t):
    return _one(t("region"), "same boolean, other boolean", _ann().equal(_ann().project("age", "name", "id")), _ann().equal(_ann().update(age=21)))


@query("SELECT 'Ann' AS name, 40 AS twice")
def tuple_project_eliminate_extend(t):
    return _ann().extend(("twice", "int", 40)).eliminate("id").project("name", "twice").relation(t("region").spark)


@query("SELECT 1 AS key, 'Bea' AS name, 20 AS age")
def tuple_rename_update(t):
    return _ann().rename(("id", "key")).update(name="Bea").relation(t("region").spark)


@query(_TUPLE)
def tuple_wrap_unwrap(t):
    return _ann().wrap("who", "name", "age").unwrap("who").relation(t("region").spark)


@query("SELECT s_suppkey, upper(s_name) AS name, s_nationkey + 1 AS next FROM supplier")
def tuple_columns(t):
    """The same operators on a struct column of every tuple."""
    wrapped = t("supplier").wrap("w", "s_name", "s_nationkey", "s_acctbal")
    w = struct_eliminate(struct_extend(F.col("w"), next=F.col("w.s_nationkey") + 1), "s_acctbal")
    w = struct_project(struct_rename(w, ["s_name", "s_nationkey", "next"], ("s_name", "name")), "name", "next")
    return wrapped.extend(("v", w_type(), w)).eliminate("w").unwrap("v").update("true", {"name": "upper(name)"})


def w_type():
    return ("Tuple", {"name": "string", "next": "int"})


# Extension, pipes, streams

@query("SELECT n_name FROM nation WHERE n_name LIKE '%A'")
def pipe(t):
    return t("nation").pipe(lambda r: r.restrict(string_match(F.col("n_name"), "*A")), lambda r: r.project("n_name"))


@query("SELECT o_orderkey, o_totalprice * 1.5 + length(o_orderpriority) AS v FROM orders")
def extension_function(t):
    """A function of the user's, here over pandas Series."""
    v = F.pandas_udf(lambda price, priority: price * 1.5 + priority.str.len(), "double")
    return t("orders").extend(("v", "double", v("o_totalprice", "o_orderpriority"))).project("o_orderkey", "v")


@query("SELECT c_nationkey, max(c_custkey) - min(c_custkey) AS width, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def extension_aggregate(t):
    """An aggregate of the user's over pandas Series beside a built-in expression."""
    width = rfold(lambda s: int(s.max() - s.min()), "long", "c_custkey")
    a = t("customer").summarizeby(["c_nationkey"], ("width", "long", width))
    return a.join(t("customer").summarizeby(["c_nationkey"], ("n", "long", aggregate(F.count(F.lit(1)), 0))))


@query("SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def extension_table(t):
    """A table function of the user's: any number of tuples for each."""
    words = lambda r: [{"p_partkey": r["p_partkey"], "word": w} for w in r["p_name"].split(" ")]
    return t("part").project("p_partkey", "p_name").flat_map(words, {"p_partkey": "long", "word": "string"})


@query("SELECT CAST(row_number() OVER (ORDER BY n_name) AS INT) AS id, n_name AS name FROM nation")
def extension_system_ids(t):
    catalog = Catalog(t("nation").spark)
    catalog.create("named", {"id": "int", "name": "string"}, ["id"], ["name"])
    system_ids(catalog, "named", "id")
    catalog.insert("named", *({"name": n} for n in t("nation").to_list("n_name")))
    return catalog["named"]


@query("SELECT count(*) AS n, true AS refused FROM region")
def extension_attribute_constraint(t):
    catalog = _relvar(t, "region")
    attribute_constraint(catalog, "region", "r_regionkey between 0 and 50")
    try:
        catalog.insert("region", {"r_regionkey": 99, "r_name": "x"})
    except AlgebraError:
        return _one(catalog["region"], "n long, refused boolean", catalog["region"].cardinality(), True)


@query("SELECT 'restrict,restrictwith,extend,rename,wrap,unwrap' AS taken, true AS refused")
def streams(t):
    stream = Relation(t("region").spark.readStream.format("rate").load())
    taken = stream.restrict("value > 3").extend(("twice", "long", "value * 2")).rename(("value", "v")).wrap("w", "v", "twice").unwrap("w")
    assert taken._df.isStreaming
    refused = 0
    for bad in (lambda: taken.df, lambda: stream.rank("value", "r"), lambda: stream.summarizeby(["value"])):
        try:
            bad()
        except AlgebraError:
            refused += 1
    return _one(t("region"), "taken string, refused boolean", ",".join(STATELESS), refused == 3)
