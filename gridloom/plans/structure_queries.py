"""Profiles, keys and lineage of the star-schema tables, as queries with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import profile as p
from gridloom.plans import lineage
from gridloom.plans.queries import TABLES, workbook

#: Foreign keys of the tables: column to table and key.
_LINKS = {("nation", "n_regionkey"): ("region", "r_regionkey"), ("customer", "c_nationkey"): ("nation", "n_nationkey"), ("orders", "o_custkey"): ("customer", "c_custkey"), ("lineitem", "l_orderkey"): ("orders", "o_orderkey"), ("lineitem", "l_partkey"): ("part", "p_partkey"), ("part", "p_size"): ("supplier", "s_suppkey")}
#: Lookups that formulas make; no column is named as a table of these.
_LOOKED_UP = {("orders", "o_custkey", "customer")}
#: Columns of the tables with their kinds: i and f are numbers, s texts, t times.
_KINDS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:f c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:f",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:f",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:f props:s",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = [p.profile(_read(spark, sf_dir, t)) for t in _KINDS]
    return reduce(DataFrame.unionByName, profiles)


def unique_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of all tables."""
    found = {t: p.unique_among(df, df.columns) for t, df in ((t, _read(spark, sf_dir, t)) for t in _KINDS)}
    return spark.createDataFrame([(f"{t}.{c}", u) for t, columns in found.items() for c, u in columns.items()], "name string, is_unique boolean")


#: Keys that hold, and some that don't.
_REFERS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_linenumber", "region", "r_regionkey"), ("part", "p_size", "nation", "n_nationkey"), ("events", "user_id", "customer", "c_custkey"), ("events", "user_id", "supplier", "s_suppkey")]


def orphans_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each foreign key that has any: values that aren't there, their rows, and the greatest as text."""
    tables = {t: _read(spark, sf_dir, t) for t in _KINDS}
    return p.orphans(tables, _REFERS).groupBy("table", "column", "target").agg(F.count("*").alias("values"), F.sum("rows").alias("rows"), F.max("value").alias("last"))


def named_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys of tables whose columns are named as keys: by name and values, by lookups of the same file and of another."""
    d = {t: _read(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem")}
    tables = {
        "nations": d["nation"].select(F.col("n_nationkey").alias("id"), "n_name"),
        "customers": d["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation_id"), "c_name"),
        "purchases": d["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_no"), F.col("o_custkey").alias("buyer"), "o_totalprice"),
        "lines": d["lineitem"].select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_code"), F.col("l_orderkey").alias("purchase"), F.col("l_orderkey").alias("purchases_id")),
    }
    keys = {t: p.primary_key(df) for t, df in tables.items()}
    looked = {("customers", "nation_id", "nations"), ("purchases", "buyer", "customers")}
    links = p.foreign_keys(tables, keys, looked, {t: "other.xlsx" if t == "purchases" else "book.xlsx" for t in tables})
    return spark.createDataFrame([(k.table, k.column, f"{k.target}.{k.key}", k.confidence) for k in links], "name string, key string, target string, confidence double")


def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for (table, column), (target, key) in _LINKS.items():
        one = p.overlap(_read(spark, sf_dir, table), column, _read(spark, sf_dir, target), key).select(F.lit(f"{table}.{column}").alias("name"), "contained", "covered")
        out = one if out is None else out.unionByName(one)
    return out


def inferred_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: _read(spark, sf_dir, t) for t in _KINDS}
    keys = {t: p.primary_key(df) for t, df in tables.items()}
    links = p.foreign_keys(tables, keys, _LOOKED_UP)
    return spark.createDataFrame([(t, k, None, None) for t, k in keys.items()] + [(k.table, k.column, f"{k.target}.{k.key}", k.confidence) for k in links], "name string, key string, target string, confidence double")


def _formulas(spark: SparkSession, sf_dir: str):
    w = workbook(spark, sf_dir)
    for t, c, f in (("customer", "nation", "=VLOOKUP(C2,nation!A:B,2,FALSE)"), ("customer", "total", "=SUMIF(orders!B:B,A2,orders!D:D)"), ("customer", "same", "=D2"), ("orders", "half", "=D2/2")):
        w.derive(t, c, f)
    return w


def lineage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.weighted(_formulas(spark, sf_dir))


def lineage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _formulas(spark, sf_dir)
    return lineage.at_level(lineage.weighted(w), lineage.tables_of(w))


def formula_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of a formula for each order, built in a column, as a workbook's cells would have them."""
    cells = _read(spark, sf_dir, "orders").select(F.lit("orders.xlsx").alias("file"), F.lit("Orders").alias("sheet"), (F.col("o_orderkey") % 3).cast("int").alias("col"), F.when(F.col("o_totalprice") > 100000, F.concat(F.lit('=IF(SUM(D'), "o_orderkey", F.lit(')>1,"MAX(",_xlfn.XLOOKUP(A1,B:B,C:C))'))).otherwise("=SUM(A1)+sum(B1)").alias("formula"))
    return lineage.function_totals(lineage.inventory(cells))


QUERIES = {f.__name__: f for f in (profile_columns, unique_columns, orphans_per_key, named_keys, key_overlap, inferred_keys, lineage_columns, lineage_tables, formula_functions)}


def _profiled(table: str, column: str, kind: str) -> str:
    blank = f"({column} IS NULL OR trim({column}) = '')" if kind == "s" else f"({column} IS NULL)"
    whole = {"i": "'integer'", "s": f"CASE WHEN bool_and(lower(trim({column})) IN {p.BOOLEAN_WORDS}) FILTER (NOT {blank}) THEN 'boolean' ELSE 'text' END", "f": f"CASE WHEN bool_and({column} = floor({column})) THEN 'integer' ELSE 'float' END", "t": f"CASE WHEN bool_and({column} = date_trunc('day', {column})) THEN 'date' ELSE 'datetime' END"}[kind]
    size = f"CAST(max(length({column})) FILTER (NOT {blank}) AS BIGINT)" if kind == "s" else "CAST(NULL AS BIGINT)"
    return f"SELECT '{column}' AS name, {whole} AS kind, count(*) FILTER ({blank}) / count(*) AS null_ratio, count(*) FILTER ({blank}) > 0 AS nullable, {size} AS max_length FROM {table}"


def _inferred() -> str:
    """Keys of all tables (their first columns, where unique) and for each other number its best target, of equal ones the first."""
    cols = {t: [c.split(":") for c in cs.split()] for t, cs in _KINDS.items()}
    first = {t: cs[0][0] for t, cs in cols.items()}
    own = " UNION ALL ".join(f"SELECT '{t}' AS t, CASE WHEN count(*) > 0 AND count(DISTINCT {k}) = count(*) THEN '{k}' END AS k FROM {t}" for t, k in first.items())
    pairs = [(t, c, o, k, at) for t, cs in cols.items() for c, kind in cs if kind in "if" for at, (o, k) in enumerate(first.items()) if o != t]
    met = " UNION ALL ".join(
        f"""SELECT '{t}' AS t, '{c}' AS c, '{o}' AS o, '{k}' AS k, {at} AS place, {(t, c, o) in _LOOKED_UP} AS looked,
            (SELECT count(*) FILTER ({c} IN (SELECT {k} FROM {o})) / nullif(count({c}), 0) FROM {t}) AS contained,
            (SELECT count(DISTINCT {k}) FILTER ({k} IN (SELECT {c} FROM {t})) / nullif(count(DISTINCT {k}), 0) FROM {o}) AS covered"""
        for t, c, o, k, at in pairs
    )
    return f"""WITH own AS ({own}), met AS ({met}),
        scored AS (SELECT met.*, CASE WHEN looked THEN {p.LOOKUP_ONLY} WHEN contained >= {p.CONTAINED} AND covered >= {p.COVERED} THEN {p.VALUES_ONLY} ELSE 0 END AS confidence
            FROM met JOIN own AS target ON target.t = met.o AND target.k IS NOT NULL LEFT JOIN own AS self ON self.t = met.t AND self.k = met.c WHERE self.t IS NULL),
        best AS (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY confidence DESC, place) AS n FROM scored WHERE confidence > 0)
        SELECT t AS name, k AS key, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS DOUBLE) AS confidence FROM own
        UNION ALL SELECT t, c, o || '.' || k, CAST(confidence AS DOUBLE) FROM best WHERE n = 1"""


ORACLE_SQL = {
    "profile_columns": " UNION ALL ".join(_profiled(t, *c.split(":")) for t, cs in _KINDS.items() for c in cs.split()),
    "inferred_keys": _inferred(),
    "unique_columns": " UNION ALL ".join(f"SELECT '{t}.{c}' AS name, count(*) > 0 AND count({x}) = count(*) AND count(DISTINCT {x}) = count(*) AS is_unique FROM {t}" for t, cs in _KINDS.items() for c, k in (y.split(":") for y in cs.split()) for x in (f"nullif(trim({c}), '')" if k == "s" else c,)),
    "orphans_per_key": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{o}' AS target, count(DISTINCT {c}) AS \"values\", count(*) AS rows, max(CAST({c} AS VARCHAR)) AS \"last\" FROM {t} WHERE {c} NOT IN (SELECT {k} FROM {o}) HAVING count(*) > 0" for t, c, o, k in _REFERS),
    "named_keys": f"""WITH hits AS (SELECT (SELECT avg(CAST(o_custkey IN (SELECT c_custkey FROM customer) AS INT)) FROM orders) AS buyers, (SELECT avg(CAST(l_orderkey IN (SELECT o_orderkey FROM orders) AS INT)) FROM lineitem) AS orders)
        SELECT DISTINCT 'customers' AS name, 'nation_id' AS key, 'nations.id' AS target, CAST({p.ALL_THREE} AS DOUBLE) AS confidence FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)
        UNION ALL SELECT 'purchases', 'buyer', 'customers.id', CAST({p.CROSS_FILE} AS DOUBLE) FROM hits
        UNION ALL SELECT 'purchases', 'customer_no', 'customers.id', CAST({p.NAME_AND_VALUES} AS DOUBLE) FROM hits WHERE buyers >= {p.CONTAINED}
        UNION ALL SELECT 'lines', 'purchase', 'purchases.id', CAST({p.NAME_AND_VALUES} AS DOUBLE) FROM hits WHERE orders >= {p.CONTAINED}
        UNION ALL SELECT 'lines', 'purchases_id', 'purchases.id', CAST({p.NAME_AND_VALUES} AS DOUBLE) FROM hits WHERE orders >= {p.CONTAINED}""",
    "key_overlap": " UNION ALL ".join(f"SELECT '{t}.{c}' AS name, (SELECT avg(CASE WHEN {c} IN (SELECT {k} FROM {o}) THEN 1.0 ELSE 0.0 END) FROM {t} WHERE {c} IS NOT NULL) AS contained, (SELECT count(DISTINCT {k}) FILTER ({k} IN (SELECT {c} FROM {t})) / count(DISTINCT {k}) FROM {o}) AS covered" for (t, c), (o, k) in _LINKS.items()),
    "lineage_columns": """SELECT source, target, op, CASE WHEN target LIKE 'customer%' THEN (SELECT count(*) FROM customer) ELSE (SELECT count(*) FROM orders) END AS weight FROM (VALUES
        ('customer.c_nationkey', 'customer.nation', 'join'), ('nation.n_nationkey', 'customer.nation', 'join'), ('nation.n_name', 'customer.nation', 'join'), ('orders.o_custkey', 'customer.total', 'aggregate'), ('customer.c_custkey', 'customer.total', 'aggregate'),
        ('orders.o_totalprice', 'customer.total', 'aggregate'), ('customer.c_acctbal', 'customer.same', 'copy'), ('orders.o_totalprice', 'orders.half', 'calculate')) t(source, target, op)""",
    "lineage_tables": "SELECT source, target, op, CAST(2 * (SELECT count(*) FROM customer) AS BIGINT) AS weight FROM (VALUES ('nation', 'customer', 'join'), ('orders', 'customer', 'aggregate')) t(source, target, op)",
    "formula_functions": "SELECT name, CAST(n AS BIGINT) AS n FROM (SELECT 'IF' AS name, count(*) FILTER (o_totalprice > 100000) AS n FROM orders UNION ALL SELECT 'XLOOKUP', count(*) FILTER (o_totalprice > 100000) FROM orders UNION ALL SELECT 'SUM', sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 2 END) FROM orders)",
}
