"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, partition_violations, violations
from ..functions.aggregates import count_where, ravg, ravgd, rcount, rcountd, rmax, rmin, rrelation, rsum, rsumd
from ..functions.text import string_match
from ..relation import Relation
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function of tables by name, with its SQL."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda name: table(spark, sf_dir, name))
            return out.df if isinstance(out, Relation) else out

        QUERIES[f.__name__], SQL[f.__name__] = run, sql
        return run

    return add


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


@query("""SELECT n_name, CAST(count(*) AS INT) AS suppliers, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY n_name""")
def suppliers_by_nation(t):
    regions = t("region").restrict("r_name = 'EUROPE'").rename(("r_regionkey", "n_regionkey"))
    nations = t("nation").join(regions).rename(("n_nationkey", "s_nationkey"))
    rows = t("supplier").extend(("cents", "long", _cents("s_acctbal"))).join(nations)
    return rows.summarizeby(["n_name"], ("suppliers", "int", rcount()), ("cents", "long", rsum("cents")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers_by_nation(spark, sf_dir)


@query("SELECT DISTINCT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def restrict(t):
    return t("orders").restrict((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))


@query("SELECT DISTINCT * FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'")
def restrictwith(t):
    return t("customer").restrictwith("c_acctbal < 0 AND c_mktsegment = 'BUILDING'")


@query("SELECT * FROM part WHERE regexp_matches(p_type, '^.*[A-M].?$')")
def restrict_glob(t):
    return t("part").restrict(string_match(F.col("p_type"), "*[A-M]") | string_match(F.col("p_type"), "*[A-M]?"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def project(t):
    return t("lineitem").project("l_returnflag", "l_linestatus")


@query("SELECT DISTINCT c_custkey, c_mktsegment FROM customer")
def project_key(t):
    return t("customer").project("c_custkey", "c_mktsegment")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def eliminate(t):
    return t("orders").eliminate("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@query("SELECT s_suppkey AS k, s_name AS b, s_nationkey AS a, s_acctbal FROM supplier")
def rename(t):
    return t("supplier").rename(("s_suppkey", "k"), ("s_name", "a"), ("a", "b"), ("s_nationkey", "a"))


@query("SELECT *, l_quantity * 2 AS twice, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem")
def extend(t):
    return t("lineitem").extend(("twice", "double", "l_quantity * 2"), ("cents", "long", _cents("l_extendedprice")))


@query("SELECT DISTINCT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update(t):
    return t("customer").update("c_acctbal < 0", {"c_acctbal": "0.0"})


@query("SELECT * EXCLUDE (n_nationkey) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_using(t):
    return t("customer").join(t("nation"), using={"c_nationkey": "n_nationkey"})


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, l_linenumber, l_partkey FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) ON l_orderkey = o_orderkey")
def join(t):
    lines = t("lineitem").project("l_orderkey", "l_linenumber", "l_partkey").rename(("l_orderkey", "o_orderkey"))
    return t("orders").join(lines)


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_no_common(t):
    return t("nation").project("n_name").join(t("region").project("r_name"))


@query("SELECT DISTINCT c_mktsegment, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey")
def compose(t):
    return t("customer").project("c_custkey", "c_mktsegment").compose(t("orders").project("o_custkey", "o_orderpriority"), using={"c_custkey": "o_custkey"})


@query("SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name < b.n_name")
def self_join_theta(t):
    a = t("nation").project("n_name", "n_regionkey").rename(("n_name", "one"))
    b = t("nation").project("n_name", "n_regionkey").rename(("n_name", "two"))
    return a.join(b).restrict("one < two").eliminate("n_regionkey")


@query("SELECT a.r_name AS one, b.r_name AS two FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def theta_join(t):
    a, b = (t("region").rename(("r_regionkey", f"k{i}"), ("r_name", n)) for i, n in ((0, "one"), (1, "two")))
    return a.theta_join(b, "k0 < k1").project("one", "two")


@query("SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'MACHINERY')")
def semijoin(t):
    return t("customer").restrict("c_mktsegment = 'MACHINERY'").semijoin(t("orders"), using={"c_custkey": "o_custkey"})


@query("""SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN
(SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')))""")
def semijoin_chain(t):
    steps = ((t("nation"), {"r_regionkey": "n_regionkey"}), (t("customer"), {"n_nationkey": "c_nationkey"}), (t("orders"), {"c_custkey": "o_custkey"}))
    return t("region").restrict("r_name = 'ASIA'").select_related(*steps)


@query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semiminus(t):
    return t("orders").restrict("o_orderpriority = '1-URGENT'").semiminus(t("customer"), using={"o_custkey": "c_custkey"})


@query("SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation, region")
def times(t):
    return t("nation").eliminate("n_regionkey").times(t("region"))


_FLAGS = "(SELECT DISTINCT p_brand FROM part) AS d WHERE NOT EXISTS (SELECT 1 FROM {divisor} AS s WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT p_brand, p_type FROM part) AS m WHERE m.p_brand = d.p_brand AND m.p_type = s.p_type))"


@query("SELECT p_brand FROM " + _FLAGS.format(divisor="(SELECT DISTINCT p_type FROM part WHERE p_size < 3)"))
def divide(t):
    return t("part").project("p_brand").divide(t("part").restrict("p_size < 3").project("p_type"), t("part").project("p_brand", "p_type"))


@query("SELECT DISTINCT p_brand FROM part")
def divide_empty_divisor(t):
    return t("part").project("p_brand").divide(t("part").restrict("p_size < 0").project("p_type"), t("part").project("p_brand", "p_type"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer UNION SELECT n_nationkey FROM nation")
def union(t):
    return t("supplier").project("s_nationkey").rename(("s_nationkey", "k")).union(t("customer").project("c_nationkey").rename(("c_nationkey", "k")), t("nation").project("n_nationkey").rename(("n_nationkey", "k")))


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'O'")
def dunion(t):
    return t("orders").restrict("o_orderstatus = 'F'").dunion(t("orders").restrict("o_orderstatus = 'O'"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect(t):
    return t("orders").restrict("o_orderstatus = 'F'").project("o_custkey").intersect(t("orders").restrict("o_orderstatus = 'O'").project("o_custkey"))


@query("SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def minus(t):
    return t("orders").project("o_custkey").minus(t("orders").restrict("o_orderstatus = 'O'").project("o_custkey"))


@query("""SELECT NOT EXISTS (FROM a EXCEPT FROM b) AND NOT EXISTS (FROM b EXCEPT FROM a) AS is_equal, NOT EXISTS (FROM a EXCEPT FROM b) AS is_subsetof, NOT EXISTS (FROM b EXCEPT FROM a) AS is_supersetof
FROM (SELECT 1), (SELECT 1) AS x(y)""".replace("FROM a", "SELECT DISTINCT o_custkey FROM orders").replace("FROM b", "SELECT c_custkey FROM customer"))
def is_comparisons(t):
    return t("orders").project("o_custkey").rename(("o_custkey", "k")).contains(t("customer").project("c_custkey").rename(("c_custkey", "k")))


@query("""SELECT n_nationkey, n_name, n_regionkey, CAST(count(s_suppkey) AS INT) AS rich, CAST(coalesce(sum(CAST(round(s_acctbal * 100) AS BIGINT)), 0) AS BIGINT) AS cents
FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON s_nationkey = n_nationkey GROUP BY ALL""")
def summarize_per(t):
    rich = t("supplier").restrict("s_acctbal > 9000").extend(("cents", "long", _cents("s_acctbal"))).rename(("s_nationkey", "n_nationkey"))
    sums = rich.summarize(t("nation").project("n_nationkey"), ("rich", "int", rcount()), ("cents", "long", rsum("cents")))
    return t("nation").join(sums)


@query("SELECT CAST(count(*) AS INT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-01-01'")
def summarize_dee(t):
    lines = t("lineitem").restrict("l_shipdate > timestamp '1998-01-01'")
    lines = lines.extend(("q", "long", "l_quantity"))
    return lines.summarize(Relation.dee(lines.spark), ("n", "int", rcount()), ("quantity", "long", rsum("q")))


@query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS INT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
max(l_shipdate) AS latest FROM lineitem GROUP BY ALL""")
def summarizeby(t):
    lines = t("lineitem").extend(("q", "long", "l_quantity"), ("c", "long", _cents("l_extendedprice")))
    return lines.summarizeby(["l_returnflag", "l_linestatus"], ("n", "int", rcount()), ("quantity", "long", rsum("q")), ("cents", "long", rsum("c")), ("latest", None, rmax("l_shipdate")))


@query("SELECT CAST(count(*) AS INT) AS n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0")
def summarizeby_none(t):
    return t("orders").restrict("o_totalprice < 0").summarizeby([], ("n", "int", rcount()))


def _agg(name: str, build, sql: str) -> None:
    def f(t):
        return t("part").summarizeby(["p_brand"], ("value", "long", build))

    f.__name__ = f"agg_{name}"
    query(f"SELECT p_brand, CAST({sql} AS BIGINT) AS value FROM part GROUP BY p_brand")(f)


_agg("rcount", rcount(), "count(*)")
_agg("rcountd", rcountd("p_size"), "count(DISTINCT p_size)")
_agg("rsum", rsum("p_size"), "sum(p_size)")
_agg("rsumd", rsumd("p_size"), "sum(DISTINCT p_size)")
_agg("ravg", ravg("p_size"), "floor(sum(p_size) / count(*))")
_agg("ravgd", ravgd("p_size"), "floor(sum(DISTINCT p_size) / count(DISTINCT p_size))")
_agg("rmin", rmin("p_size"), "min(p_size)")
_agg("rmax", rmax("p_size"), "max(p_size)")
_agg("count_where", count_where("p_size > 25"), "count(*) FILTER (WHERE p_size > 25)")


@query("SELECT *, rank() OVER (ORDER BY p_size) AS r FROM part")
def rank_asc(t):
    return t("part").rank("p_size", "r")


@query("SELECT *, rank() OVER (ORDER BY s_acctbal DESC) AS r FROM supplier")
def rank_desc(t):
    return t("supplier").rank("s_acctbal", "r", descending=True)


@query("SELECT * FROM orders QUALIFY rank() OVER (ORDER BY o_totalprice DESC) <= 10")
def topk(t):
    return t("orders").top("o_totalprice", 10)


@query("SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority) - 1 AS n FROM orders")
def tag(t):
    return t("orders").tag("n", ascending=["o_orderdate"])


@query("SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey, o_orderstatus, o_orderdate, o_orderpriority) - 1 AS n FROM orders")
def tag_within(t):
    return t("orders").tag("n", descending=["o_totalprice"], within=["o_custkey"])


@query("SELECT *, row_number() OVER (ORDER BY s_nationkey, s_suppkey, s_name, s_acctbal) - 1 + 100 AS n FROM supplier")
def tag_start(t):
    return t("supplier").tag("n", ascending=["s_nationkey"], start=100)


@query("SELECT n_regionkey, CAST(count(*) AS INT) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def group(t):
    nested = t("nation").group("ns", "n_nationkey", "n_name")
    return nested.extend(("n", "int", F.size("ns")), ("names", "string", F.array_join(F.array_sort(F.transform("ns", lambda x: x["n_name"])), ","))).eliminate("ns")


@query("SELECT * FROM nation")
def ungroup(t):
    return t("nation").group("ns", "n_nationkey", "n_name").ungroup("ns").project("n_nationkey", "n_name", "n_regionkey")


@query("SELECT s_suppkey, s_name || ':' || s_nationkey AS inside FROM supplier")
def wrap(t):
    wrapped = t("supplier").eliminate("s_acctbal").wrap("w", "s_name", "s_nationkey")
    return wrapped.extend(("inside", "string", "concat(w.s_name, ':', w.s_nationkey)")).eliminate("w")


@query("SELECT * FROM supplier")
def unwrap(t):
    return t("supplier").wrap("w", "s_name", "s_nationkey").unwrap("w").project("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("""SELECT n_nationkey, n_name, n_regionkey, CAST(count(s_suppkey) AS INT) AS n, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS keys
FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 8000) ON s_nationkey = n_nationkey GROUP BY ALL""")
def rvajoin(t):
    rich = t("supplier").restrict("s_acctbal > 8000").project("s_suppkey", "s_nationkey")
    nested = t("nation").rvajoin(rich, "ss", using={"n_nationkey": "s_nationkey"})
    return nested.extend(("n", "int", F.size("ss")), ("keys", "string", F.array_join(F.transform("ss", lambda x: x["s_suppkey"].cast("string")), ","))).eliminate("ss")


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def summarize_relation(t):
    nested = t("customer").summarizeby(["c_nationkey"], ("s", None, rrelation("c_mktsegment")))
    return nested.extend(("segments", "string", F.array_join(F.transform("s", lambda x: x["c_mktsegment"]), ","))).eliminate("s")


@query("""SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS INT) AS "F", CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS INT) AS "O",
CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS INT) AS "P", CAST(count(*) AS INT) AS "Total" FROM orders GROUP BY o_orderpriority""")
def crosstab(t):
    return t("orders").crosstab("o_orderstatus", "o_orderpriority")


_CLOSURE = "WITH RECURSIVE e AS ({edges}), c AS (SELECT * FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c"


@query(_CLOSURE.format(edges="SELECT n_nationkey AS a, n_nationkey + n_regionkey + 1 AS b FROM nation"))
def tclose(t):
    return t("nation").extend(("b", "int", "n_nationkey + n_regionkey + 1")).project("n_nationkey", "b").rename(("n_nationkey", "a")).tclose()


@query(_CLOSURE.format(edges="SELECT n_nationkey AS a, CAST((n_nationkey * 3 + 1) % 25 AS INT) AS b FROM nation"))
def tclose_cyclic(t):
    return t("nation").extend(("b", "int", "(n_nationkey * 3 + 1) % 25")).project("n_nationkey", "b").rename(("n_nationkey", "a")).tclose()


@query("""SELECT k0, why FROM (SELECT c_custkey AS k0, CASE WHEN n > 1 THEN 'referred to more than once' WHEN n IS NULL THEN 'not referred to' END AS why
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1) ON o_custkey = c_custkey) WHERE why IS NOT NULL""")
def constraint_violations_association(t):
    return violations(t("orders").restrict("o_totalprice > 50000"), ["o_custkey"], "1", t("customer"), ["c_custkey"], "1")


@query("""SELECT n_nationkey AS k0, CASE WHEN n IS NULL THEN 'in no part' ELSE 'in more than one part' END AS why FROM nation LEFT JOIN
(SELECT k, count(*) AS n FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 12 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 10 AND 20) GROUP BY k) ON k = n_nationkey WHERE n IS NULL OR n > 1""")
def constraint_violations_partition(t):
    parts = [(t("nation").restrict(c), ["n_nationkey"]) for c in ("n_nationkey < 12", "n_nationkey between 10 and 20")]
    return partition_violations(t("nation"), ["n_nationkey"], parts)


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def constraint_violations_identifier(t):
    return t("lineitem").summarizeby(["l_orderkey", "l_linenumber"], ("n", "int", rcount())).restrict("n > 1")


def _relvar(t, name: str, *, rows: str = "true") -> Catalog:
    value = t(name).restrict(rows)
    catalog = Catalog(value.spark)
    catalog.create(name, {f.name: f.dataType for f in value._df.schema.fields}, *(tuple(k) for k in value.keys))
    catalog.set(name, value)
    return catalog


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey < 5 THEN 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier")
def relvar_updateper(t):
    catalog = _relvar(t, "supplier")
    new = t("supplier").restrict("s_nationkey < 5").project("s_suppkey").extend(("s_acctbal", "double", "1.5"))
    catalog.updateper("supplier", new)
    return catalog["supplier"]


@query("SELECT * FROM supplier WHERE s_suppkey <= 50 UNION SELECT s_suppkey, 'new', s_nationkey, 0.0 FROM supplier WHERE s_suppkey > 50")
def relvar_uinsert(t):
    catalog = _relvar(t, "supplier", rows="s_suppkey <= 50")
    catalog.uinsert("supplier", t("supplier").update("true", {"s_name": "'new'", "s_acctbal": "0.0D"}))
    return catalog["supplier"]


@query("SELECT * FROM supplier WHERE s_acctbal >= 0")
def relvar_delete(t):
    catalog = _relvar(t, "supplier")
    catalog.delete("supplier", "s_acctbal < 0")
    return catalog["supplier"]


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN upper(s_name) ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier")
def relvar_update(t):
    catalog = _relvar(t, "supplier")
    catalog.update("supplier", "s_acctbal < 0", {"s_name": "upper(s_name)"})
    return catalog["supplier"]


@query("SELECT * FROM region WHERE r_regionkey = 2")
def relvar_restrictone(t):
    return _relvar(t, "region").restrictone("region", {"r_regionkey": 2})


@query("SELECT * FROM nation")
def relvar_transaction_rollback(t):
    catalog = _relvar(t, "nation")
    catalog.begin()
    catalog.delete("nation", "n_regionkey = 1")
    catalog.rollback()
    return catalog["nation"]
