"""Formula columns over the star-schema tables, as queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.workbook import Workbook

#: Row order of the tables; formulas' first match is by that order.
TABLES = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
}


def workbook(spark: SparkSession, sf_dir: str) -> Workbook:
    """All tables; each is opened when a formula first names it."""
    w = Workbook(spark)
    for name, order in TABLES.items():
        w.add(name, lambda name=name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), order)
    return w


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def formulas(name: str, table: str, keep: str, columns: dict[str, str], sql: str, others: dict[str, dict[str, str]] | None = None, row: int | None = None) -> None:
    """A query of the columns keep and the formula columns, beside what SQL says it is (None: no SQL). row: where the formulas stand."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = workbook(spark, sf_dir)
        for t, more in ({**(others or {}), table: columns}).items():
            for c, f in more.items():
                w.derive(t, c, f, row=row)
        return w.recompute(table).select(*keep.split(), *columns)

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


formulas("customer_activity", "customer", "c_custkey c_name", {
    "nation": "=VLOOKUP(C2,nation!A:B,2,FALSE)", "n_orders": "=COUNTIF(orders!B:B,A2)", "total": "=SUMIF(orders!B:B,A2,orders!D:D)", "status": '=IF(G2>0,"active","idle")',
}, """SELECT c_custkey, c_name, n_name AS nation, coalesce(n, 0) AS n_orders, coalesce(s, 0.0) AS total, CASE WHEN coalesce(n, 0) > 0 THEN 'active' ELSE 'idle' END AS status
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey""")  # fmt: skip
formulas("row_arithmetic", "lineitem", "l_orderkey l_linenumber", {"net": "=F2*(1-G2)", "charge": "=F2*(1-G2)*(1+H2)", "unit": "=F2/E2", "none": "=F2/(D2-D2)"},
         "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice / nullif(l_quantity, 0) AS \"unit\", CAST(NULL AS DOUBLE) AS \"none\" FROM lineitem")
formulas("unary_percent", "lineitem", "l_orderkey l_linenumber", {"minus": "=-E2", "percent": "=E2%", "both": "=-E2%+5%"},
         "SELECT l_orderkey, l_linenumber, -l_quantity AS minus, l_quantity / 100.0 AS percent, -(l_quantity / 100.0) + 0.05 AS \"both\" FROM lineitem")
formulas("power", "part", "p_partkey", {"square": "=E2^2", "tower": "=2^(E2%)", "right": "=2^3^2", "minus": "=-2^2"},
         "SELECT p_partkey, CAST(pow(p_size, 2) AS DOUBLE) AS square, pow(2, p_size / 100.0) AS tower, 512.0::DOUBLE AS \"right\", 4.0::DOUBLE AS minus FROM part")
formulas("concat", "customer", "c_custkey", {"label": '=B2&" ("&E2&")"', "coded": '=CONCATENATE(E2,"-",A2)'},
         "SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS label, c_mktsegment || '-' || CAST(c_custkey AS VARCHAR) AS coded FROM customer")
formulas("comparisons", "lineitem", "l_orderkey l_linenumber", {"eq": '=I2="A"', "ne": '=I2<>"N"', "lt": "=E2<10", "ge": "=E2>=25", "gt": "=G2>H2", "le": "=D2<=2"},
         "SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS eq, l_returnflag <> 'N' AS ne, l_quantity < 10 AS lt, l_quantity >= 25 AS ge, l_discount > l_tax AS gt, l_linenumber <= 2 AS le FROM lineitem")
formulas("fn_if_ifs", "orders", "o_orderkey", {"size": '=IF(D2>200000,"big","small")', "band": '=IFS(D2<50000,1,D2<150000,2.5,TRUE,3)', "open": '=IF(C2="O",D2)'},
         "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size, CASE WHEN o_totalprice < 50000 THEN 1.0 WHEN o_totalprice < 150000 THEN 2.5 ELSE 3.0 END::DOUBLE AS band, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS open FROM orders")
formulas("fn_iferror", "lineitem", "l_orderkey l_linenumber", {"safe": "=IFERROR(F2/(D2-1),0)", "found": '=IFNA(VLOOKUP(D2+100,nation!A:B,2,FALSE),"none")'},
         "SELECT l_orderkey, l_linenumber, coalesce(l_extendedprice / nullif(l_linenumber - 1, 0), 0) AS safe, 'none' AS found FROM lineitem")
formulas("fn_logic", "lineitem", "l_orderkey l_linenumber", {"both": '=AND(E2>10,I2="N")', "either": '=OR(E2>45,J2="F",G2=0)', "neither": "=NOT(E2>10)"},
         "SELECT l_orderkey, l_linenumber, l_quantity > 10 AND l_returnflag = 'N' AS \"both\", l_quantity > 45 OR l_linestatus = 'F' OR l_discount = 0 AS either, NOT l_quantity > 10 AS neither FROM lineitem")
formulas("fn_isblank", "orders", "o_orderkey", {"blank": "=ISBLANK(VLOOKUP(B2,customer!A:E,2,FALSE))", "never": "=ISBLANK(A2)"},
         "SELECT o_orderkey, c_custkey IS NULL AS blank, FALSE AS never FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
formulas("fn_round_family", "customer", "c_custkey", {"r0": "=ROUND(D2)", "r1": "=ROUND(D2,1)", "up": "=ROUNDUP(D2,1)", "down": "=ROUNDDOWN(D2,1)", "tens": "=ROUND(D2,-1)"},
         "SELECT c_custkey, round(c_acctbal) + 0.0 AS r0, round(c_acctbal * 10.0) / 10.0 + 0.0 AS r1, ceil(c_acctbal * 10.0) / 10.0 + 0.0 AS up, floor(c_acctbal * 10.0) / 10.0 + 0.0 AS down, round(c_acctbal * pow(10.0, -1)) / pow(10.0, -1) + 0.0 AS tens FROM customer")
formulas("fn_int_trunc_abs", "customer", "c_custkey", {"whole": "=INT(D2)", "cut": "=TRUNC(D2)", "size": "=ABS(D2)", "key": "=ABS(C2-10)"},
         "SELECT c_custkey, floor(c_acctbal) AS whole, trunc(c_acctbal) AS cut, abs(c_acctbal) AS size, CAST(abs(c_nationkey - 10) AS BIGINT) AS key FROM customer")
formulas("fn_mod", "customer", "c_custkey", {"m7": "=MOD(A2,7)", "negative": "=MOD(A2-800,7)", "zero": "=MOD(A2,C2-C2)"},
         "SELECT c_custkey, c_custkey % 7 AS m7, (c_custkey - 800) % 7 AS negative, CAST(NULL AS BIGINT) AS zero FROM customer")
formulas("fn_sqrt", "customer", "c_custkey", {"root": "=SQRT(D2)", "plain": "=SQRT(A2)"},
         "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END AS root, sqrt(c_custkey) AS plain FROM customer")
formulas("fn_case_trim_len", "part", "p_partkey", {"up": "=UPPER(B2)", "low": "=LOWER(C2)", "n": "=LEN(D2)", "cut": '=TRIM("  "&B2&" ")'},
         "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_type) AS n, trim('  ' || p_name || ' ') AS cut FROM part")
formulas("fn_left_right_mid", "part", "p_partkey", {"l1": "=LEFT(B2)", "l3": "=LEFT(B2,3)", "r2": "=RIGHT(C2,2)", "m": "=MID(D2,2,4)"},
         "SELECT p_partkey, left(p_name, 1) AS l1, left(p_name, 3) AS l3, right(p_brand, 2) AS r2, substr(p_type, 2, 4) AS m FROM part")
formulas("fn_substitute_find", "part", "p_partkey", {"dashed": '=SUBSTITUTE(C2,"#","-")', "at": '=FIND("#",C2)', "absent": '=SEARCH("zzz",C2)'},
         "SELECT p_partkey, replace(p_brand, '#', '-') AS dashed, CAST(position('#' IN p_brand) AS BIGINT) AS at, CAST(0 AS BIGINT) AS absent FROM part")
formulas("fn_text_value", "part", "p_partkey", {"shown": '=TEXT(E2,"0.00")', "number": '=VALUE(RIGHT(C2,1))', "bad": "=VALUE(D2)"},
         "SELECT p_partkey, CAST(p_size AS VARCHAR) AS shown, TRY_CAST(right(p_brand, 1) AS DOUBLE) AS number, TRY_CAST(p_type AS DOUBLE) AS bad FROM part")
formulas("fn_date_parts", "orders", "o_orderkey", {"y": "=YEAR(E2)", "m": "=MONTH(E2)", "d": "=DAY(E2)"},
         "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders")
formulas("fn_today_now", "region", "r_regionkey", {"later": "=NOW()>=TODAY()"}, "SELECT r_regionkey, TRUE AS later FROM region")
formulas("vlookup_exact", "lineitem", "l_orderkey l_linenumber", {"price": "=VLOOKUP(B2,part!A:F,6,FALSE)", "brand": "=VLOOKUP(B2,part!A:F,3,FALSE)", "list": "=L2*E2"},
         "SELECT l_orderkey, l_linenumber, p_retailprice AS price, p_brand AS brand, p_retailprice * l_quantity AS list FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
formulas("vlookup_approx_as_exact", "lineitem", "l_orderkey l_linenumber", {"name": "=VLOOKUP(B2,part!A:F,2)"},
         "SELECT l_orderkey, l_linenumber, p_name AS name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
formulas("xlookup_default", "orders", "o_orderkey", {"segment": '=XLOOKUP(B2+100,customer!A:A,customer!E:E,"unknown")'},
         "SELECT o_orderkey, coalesce(c_mktsegment, 'unknown') AS segment FROM orders LEFT JOIN customer ON o_custkey + 100 = c_custkey")
formulas("index_match", "supplier", "s_suppkey", {"nation": "=INDEX(nation!B:B,MATCH(C2,nation!A:A,0))"},
         "SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
formulas("lookup_nested", "customer", "c_custkey", {"region": "=VLOOKUP(VLOOKUP(C2,nation!A:C,3,FALSE),region!A:B,2,FALSE)"},
         "SELECT c_custkey, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
formulas("lookup_first_match", "customer", "c_custkey", {"first_order": "=INDEX(orders!A:A,MATCH(A2,orders!B:B,0))", "first_price": "=XLOOKUP(A2,orders!B:B,orders!D:D)"},
         "SELECT c_custkey, k AS first_order, p AS first_price FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k, arg_min(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey")
for _name, _excel, _sql in (("sumif", "=SUMIF(orders!B:B,A2,orders!D:D)", "coalesce(sum(o_totalprice), 0)"), ("countif", "=COUNTIF(orders!B:B,A2)", "count(o_orderkey)"), ("averageif", "=AVERAGEIF(orders!B:B,A2,orders!D:D)", "avg(o_totalprice)")):
    formulas(_name, "customer", "c_custkey", {"v": _excel}, f"SELECT c_custkey, {_sql} AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
for _name, _excel, _sql in (
    ("sumifs", '=SUMIFS(lineitem!F:F,lineitem!B:B,A2,lineitem!I:I,"R")', "coalesce(sum(l_extendedprice), 0)"), ("countifs", '=COUNTIFS(lineitem!B:B,A2,lineitem!I:I,"R")', "count(l_partkey)"), ("averageifs", '=AVERAGEIFS(lineitem!E:E,lineitem!B:B,A2,lineitem!I:I,"R")', "avg(l_quantity)"),
    ("minifs", '=MINIFS(lineitem!F:F,lineitem!B:B,A2,lineitem!I:I,"R")', "min(l_extendedprice)"), ("maxifs", '=MAXIFS(lineitem!F:F,lineitem!B:B,A2,lineitem!I:I,"R")', "max(l_extendedprice)"),
):
    formulas(_name, "part", "p_partkey", {"v": _excel}, f"SELECT p_partkey, {_sql} AS v FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' GROUP BY 1")
formulas("sumif_static_criteria", "supplier", "s_suppkey", {"heavy": '=SUMIFS(lineitem!F:F,lineitem!C:C,A2,lineitem!E:E,">25")', "n": '=COUNTIFS(lineitem!C:C,A2,lineitem!E:E,">25")'},
         "SELECT s_suppkey, coalesce(sum(l_extendedprice), 0) AS heavy, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 25 GROUP BY 1")
formulas("countif_wildcard", "region", "r_regionkey", {"brands": '=COUNTIF(part!C:C,"Brand#1*")', "odd": '=COUNTIF(part!C:C,"?rand#2?")', "none": '=COUNTIF(part!B:B,"100%*")'},
         "SELECT r_regionkey, (SELECT count(*) FROM part WHERE p_brand LIKE 'Brand#1%') AS brands, (SELECT count(*) FROM part WHERE p_brand LIKE '_rand#2_') AS odd, CAST(0 AS BIGINT) AS \"none\" FROM region")
formulas("countif_ne", "region", "r_regionkey", {"others": '=COUNTIF(orders!C:C,"<>O")', "filled": '=COUNTIF(orders!C:C,"<>")'},
         "SELECT r_regionkey, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'O') AS others, (SELECT count(*) FROM orders WHERE o_orderstatus <> '') AS filled FROM region")
formulas("sumif_range_criterion", "customer", "c_custkey", {"dearer": '=COUNTIF(part!F:F,">"&D2)', "total": '=SUMIF(part!F:F,"<="&D2,part!E:E)', "mean": '=AVERAGEIF(part!F:F,"<"&D2,part!E:E)'},
         "SELECT c_custkey, count(p_partkey) FILTER (p_retailprice > c_acctbal) AS dearer, coalesce(sum(p_size) FILTER (p_retailprice <= c_acctbal), 0)::BIGINT AS total, avg(p_size) FILTER (p_retailprice < c_acctbal) AS mean FROM customer CROSS JOIN part GROUP BY 1")
formulas("sumifs_range_by_key", "part", "p_partkey", {"n": '=COUNTIFS(lineitem!B:B,A2,lineitem!E:E,">="&E2)', "low": '=MINIFS(lineitem!F:F,lineitem!B:B,A2,lineitem!E:E,">="&E2)', "high": '=MAXIFS(lineitem!F:F,lineitem!B:B,A2,lineitem!E:E,">="&E2)', "others": '=COUNTIFS(lineitem!B:B,A2,lineitem!D:D,"<>"&E2)'},
         "SELECT p_partkey, count(l_partkey) FILTER (l_quantity >= p_size) AS n, min(l_extendedprice) FILTER (l_quantity >= p_size) AS low, max(l_extendedprice) FILTER (l_quantity >= p_size) AS high, count(l_partkey) FILTER (l_linenumber <> p_size) AS others FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
formulas("sumifs_between", "customer", "c_custkey", {"n": '=COUNTIFS(orders!D:D,">="&D2,orders!D:D,"<="&D2+50000)', "total": '=ROUND(SUMIFS(orders!D:D,orders!D:D,">"&D2,orders!D:D,"<"&D2+50000),2)', "mean": '=ROUND(AVERAGEIFS(orders!D:D,orders!D:D,">"&D2,orders!D:D,"<"&D2+50000),2)', "low": '=MINIFS(orders!A:A,orders!D:D,">"&D2,orders!D:D,"<"&D2+50000)', "high": '=MAXIFS(orders!A:A,orders!D:D,">"&D2,orders!D:D,"<"&D2+50000)', "none": '=COUNTIFS(orders!D:D,">"&D2,orders!D:D,"<"&D2)'},
         "SELECT c_custkey, count(o_orderkey) FILTER (p >= b AND p <= b + 50000) AS n, round(coalesce(sum(p) FILTER (p > b AND p < b + 50000), 0) * 100) / 100 AS total, round(avg(p) FILTER (p > b AND p < b + 50000) * 100) / 100 AS mean, min(o_orderkey) FILTER (p > b AND p < b + 50000) AS low, max(o_orderkey) FILTER (p > b AND p < b + 50000) AS high, CAST(0 AS BIGINT) AS \"none\" FROM (SELECT c_custkey, c_acctbal AS b, o_orderkey, o_totalprice AS p FROM customer CROSS JOIN orders) GROUP BY 1")
formulas("sumifs_two_columns", "part", "p_partkey", {"n": '=COUNTIFS(lineitem!E:E,"<="&E2,lineitem!F:F,">"&F2*20)', "total": '=ROUND(SUMIFS(lineitem!F:F,lineitem!E:E,"<"&E2,lineitem!F:F,">="&F2*10,lineitem!F:F,"<"&F2*30,lineitem!I:I,"R"),2)', "others": '=COUNTIFS(lineitem!D:D,"<>"&MOD(E2,7),lineitem!E:E,">"&E2)'},
         "SELECT p_partkey, count(x) FILTER (q <= s AND x > r * 20) AS n, round(coalesce(sum(x) FILTER (q < s AND x >= r * 10 AND x < r * 30 AND f = 'R'), 0) * 100) / 100 AS total, count(x) FILTER (l <> s % 7 AND q > s) AS others FROM (SELECT p_partkey, p_size AS s, p_retailprice AS r, l_quantity AS q, l_extendedprice AS x, l_returnflag AS f, l_linenumber AS l FROM part CROSS JOIN lineitem) GROUP BY 1")
formulas("sumifs_between_by_key", "part", "p_partkey", {"n": '=COUNTIFS(lineitem!B:B,A2,lineitem!E:E,">="&E2,lineitem!E:E,"<="&E2+10)', "total": '=ROUND(SUMIFS(lineitem!F:F,lineitem!B:B,A2,lineitem!E:E,">="&E2,lineitem!E:E,"<="&E2+10),2)', "high": '=MAXIFS(lineitem!F:F,lineitem!B:B,A2,lineitem!E:E,"<"&E2,lineitem!G:G,">"&0.02)'},
         "SELECT p_partkey, count(l_partkey) FILTER (l_quantity BETWEEN p_size AND p_size + 10) AS n, round(coalesce(sum(l_extendedprice) FILTER (l_quantity BETWEEN p_size AND p_size + 10), 0) * 100) / 100 AS total, max(l_extendedprice) FILTER (l_quantity < p_size AND l_discount > 0.02) AS high FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
formulas("rows_above_below", "part", "p_partkey", {"step": "=IFERROR(E2-E1,0)", "next": "=IFERROR(E3,0)", "name_before": "=B1", "far": "=IFERROR(E9,-1)", "first": "=E$2", "share": '=IF(E1>E2,"down",E2/E$3)'},
         "SELECT p_partkey, CAST(coalesce(p_size - lag(p_size) OVER w, 0) AS BIGINT) AS step, CAST(coalesce(lead(p_size) OVER w, 0) AS BIGINT) AS next, lag(p_name) OVER w AS name_before, CAST(coalesce(lead(p_size, 7) OVER w, -1) AS BIGINT) AS far, first_value(p_size) OVER w AS first, CASE WHEN lag(p_size) OVER w > p_size THEN 'down' ELSE CAST(p_size / (SELECT p_size FROM part ORDER BY p_partkey LIMIT 1 OFFSET 1) AS VARCHAR) END AS share FROM part WINDOW w AS (ORDER BY p_partkey)", row=2)
formulas("rows_running", "part", "p_partkey", {"total": "=SUM(E$2:E2)", "before": "=SUM(E$2:E1)", "left": "=SUM(E2:E$1048576)", "n": "=COUNT(E$2:E2)", "high": "=MAX(E$4:E2)", "block": "=SUM(E$3:E$6)", "every": "=AVERAGE(E:E)"},
         "SELECT p_partkey, CAST(sum(p_size) OVER w AS BIGINT) AS total, CAST(coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p_size) AS BIGINT) AS before, CAST(sum(p_size) OVER (ORDER BY p_partkey DESC) AS BIGINT) AS left, count(p_size) OVER w AS n, CASE WHEN i > 2 THEN max(CASE WHEN i > 2 THEN p_size END) OVER w ELSE max(CASE WHEN i < 4 THEN p_size END) OVER (ORDER BY p_partkey DESC) END AS high, CAST(sum(CASE WHEN i BETWEEN 2 AND 5 THEN p_size END) OVER () AS BIGINT) AS block, avg(p_size) OVER () AS every FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i FROM part) WINDOW w AS (ORDER BY p_partkey)".replace(" AS left", " AS \"left\""), row=2)
formulas("rows_sliding", "part", "p_partkey", {"mean": "=AVERAGE(E2:E8)", "high": "=MAX(E2:E8)", "around": "=SUM(E1:E3)", "low_back": "=MIN(F1:F2)", "wide": "=SUM(E2:E501)", "n": "=COUNT(E4:E9)"},
         "SELECT p_partkey, avg(p_size) OVER (w ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS mean, max(p_size) OVER (w ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS high, CAST(sum(p_size) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS around, min(p_retailprice) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS low_back, CAST(sum(p_size) OVER (w ROWS BETWEEN CURRENT ROW AND 499 FOLLOWING) AS BIGINT) AS wide, count(p_size) OVER (w ROWS BETWEEN 2 FOLLOWING AND 7 FOLLOWING) AS n FROM part WINDOW w AS (ORDER BY p_partkey)", row=2)
formulas("rows_balance", "part", "p_partkey", {"stock": "=G1+E2-MOD(A2,9)", "faded": "=0.5*H1+E2", "moved": "=IFERROR(G1*2,0)"},
         "WITH RECURSIVE p AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) AS i FROM part), f AS (SELECT i, p_partkey, CAST(p_size AS DOUBLE) AS faded FROM p WHERE i = 1 UNION ALL SELECT p.i, p.p_partkey, 0.5 * f.faded + p.p_size FROM f JOIN p ON p.i = f.i + 1), s AS (SELECT p_partkey, CAST(sum(p_size - p_partkey % 9) OVER (ORDER BY p_partkey) AS BIGINT) AS stock FROM part) SELECT s.p_partkey, stock, faded, CAST(coalesce(lag(stock) OVER (ORDER BY s.p_partkey) * 2, 0) AS BIGINT) AS moved FROM s JOIN f USING (p_partkey)", row=2)
formulas("column_totals", "region", "r_regionkey", {"total": "=SUM(orders!D:D)", "mean": "=AVERAGE(orders!D2:D999)", "low": "=MIN(orders!D:D)", "high": "=MAX(orders!D:D)", "n": "=COUNT(orders!D:D)"},
         "SELECT r_regionkey, total, mean, low, high, n FROM region CROSS JOIN (SELECT sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, count(o_totalprice) AS n FROM orders)")
formulas("share_of_total", "orders", "o_orderkey", {"share": "=D2/SUM($D$2:$D$6)"}, "SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER () AS share FROM orders")
formulas("row_sum_avg_min_max_count", "lineitem", "l_orderkey l_linenumber", {"s": "=SUM(E2:H2)", "a": "=AVERAGE(E2,G2,H2)", "lo": "=MIN(G2:H2)", "hi": "=MAX(G2,H2)", "n": "=COUNT(E2:H2)"},
         "SELECT l_orderkey, l_linenumber, l_quantity + l_extendedprice + l_discount + l_tax AS s, (l_quantity + l_discount + l_tax) * 1.0 / 3 AS a, least(l_discount, l_tax) AS lo, greatest(l_discount, l_tax) AS hi, CAST(4 AS BIGINT) AS n FROM lineitem")
formulas("recompute_chain", "orders", "o_orderkey", {"lines": "=SUMIF(lineitem!A:A,A2,lineitem!L:L)", "gap": "=D2-G2", "large": "=IF(ABS(H2)>1000,1,0)"},
         "SELECT o_orderkey, coalesce(s, 0) AS \"lines\", o_totalprice - coalesce(s, 0) AS gap, CAST(CASE WHEN abs(o_totalprice - coalesce(s, 0)) > 1000 THEN 1 ELSE 0 END AS BIGINT) AS large FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
         {"lineitem": {"net": "=F2*(1-G2)"}})


def view_calc_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An included column keeps its stored values and gets a twin; another formula reads the stored ones."""
    w = workbook(spark, sf_dir)
    w.derive("orders", "o_totalprice", "=SUMIF(lineitem!A:A,A2,lineitem!F:F)", included=True)
    w.derive("orders", "doubled", "=D2*2")
    w.drop("orders", "o_orderdate", "o_orderpriority", "o_custkey", "o_orderstatus")
    return w.recompute("orders")


def exclude_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped columns leave the view; formulas still read them."""
    w = workbook(spark, sf_dir)
    w.derive("customer", "initial", "=LEFT(B2)&E2")
    w.drop("customer", "c_name", "c_mktsegment")
    return w.recompute("customer")


def translation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workbook(spark, sf_dir)
    for c, f in (("a", "=D2*2"), ("b", "=IF(D2>0,INDIRECT(A2),1)"), ("c", "=OFFSET(A1,1,1)"), ("d", "=ROW()"), ("e", "={1,2}"), ("f", "=TAX*2"), ("g", "=orders!D2"), ("h", "=VLOOKUP(C2,nation!A:B,2)")):
        w.derive("customer", c, f)
    return spark.createDataFrame([(t.column, t.status) for t in w.translations()], "name string, status string").groupBy("status").count().withColumnRenamed("count", "n")


QUERIES |= {f.__name__: f for f in (view_calc_twin, exclude_columns, translation_status)}
ORACLE_SQL |= {
    "view_calc_twin": "SELECT o_orderkey, o_totalprice, s AS o_totalprice_calc, o_totalprice * 2 AS doubled FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey".replace("s AS o", "coalesce(s, 0) AS o"),
    "exclude_columns": "SELECT c_custkey, c_nationkey, c_acctbal, left(c_name, 1) || c_mktsegment AS initial FROM customer",
    "translation_status": "SELECT * FROM (VALUES ('ok', CAST(2 AS BIGINT)), ('partial', CAST(2 AS BIGINT)), ('unsupported', CAST(4 AS BIGINT))) t(status, n)",
}
