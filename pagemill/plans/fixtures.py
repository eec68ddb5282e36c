"""Tables that several queries share, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table

NORM = r"trim(regexp_replace({0}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
CLAUSE_LINES = """(SELECT 0 AS doc_id, r_regionkey * 5 AS page_no, 0 AS line_no, concat(r_regionkey + 1, ' Region ', r_name) AS text FROM region WHERE r_regionkey <> 2
 UNION ALL SELECT 0, n_regionkey * 5 + 1, n_nationkey, concat(n_regionkey + 1, '.', n_nationkey + 1, ' Nation ', n_name) FROM nation)"""


def clause_lines(spark, d):
    r = table(spark, d, "region").where("r_regionkey <> 2").selectExpr("0 as doc_id", "r_regionkey * 5 as page_no", "0 as line_no", "concat(r_regionkey + 1, ' Region ', r_name) as text")
    n = table(spark, d, "nation").selectExpr("0 as doc_id", "n_regionkey * 5 + 1 as page_no", "n_nationkey as line_no", "concat(n_regionkey + 1, '.', n_nationkey + 1, ' Nation ', n_name) as text")
    return r.union(n)


#: A document that reaches every rule of the clause scan, as (page, lines).
CASES = (
    (0, ("Annex A", "A.1 Scope of tests", "7 Materials")),
    (1, ("7.1 General rules shall apply", "7.2 Steel", "7.2 Steel again", "7.3 Timber: species")),
    (2, ("9.1.1 Deep part", "9.1 Late title")),
    (4, ("9 Chapter that comes too late", "EN 1992 Concrete", "12 Loads and", "8 The method", "31.1 Beyond all", "14 Test 5", "15 Cut (off", "16 " + "Long " * 40, "7.9 x")),
    (6, tuple(f"10.{k} Crowded page {chr(64 + k)}" for k in range(1, 14))),
    (7, tuple(f"11.{k} Listed part ..... {k}" for k in range(1, 6))),
    (8, ("N.A.2 National choice", "Annex NA", "B.10 Tenth", "B.2 Second", "18 Fire design", "18.10 Walls", "18.9 Slabs")),
)
CASE_ROWS = [(1, page, k, text) for page, lines in CASES for k, text in enumerate(lines)]
CASE_LINES = f"""(SELECT * FROM {CLAUSE_LINES} UNION ALL SELECT * FROM (VALUES {", ".join(f"({d}, {p}, {k}, '{t}')" for d, p, k, t in CASE_ROWS)}) v(doc_id, page_no, line_no, text))"""


def case_lines(spark, d):
    return clause_lines(spark, d).union(spark.createDataFrame(CASE_ROWS, "doc_id int, page_no int, line_no int, text string"))


#: Marks on pages: one row for each line of an order (some line numbers occur twice in an order).
MARK_COLUMNS = {"a": "cast(min(l_suppkey) % 40 as double)", "b": "cast(min(l_partkey) % 90 as double)", "q": "cast(min(l_quantity) as double)", "f": "min(l_returnflag)"}
MARKS = f"(SELECT l_orderkey AS k, l_linenumber AS n, {', '.join(f'{e} AS {c}' for c, e in MARK_COLUMNS.items())} FROM lineitem GROUP BY 1, 2)"


def marks(spark, d, *columns):
    """The marks as ``columns``, expressions that Spark and the SQL read alike."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return rows.agg(*[F.expr(e).alias(c) for c, e in MARK_COLUMNS.items()]).selectExpr(*columns)


def marks_sql(*columns):
    return f"(SELECT {', '.join(columns)} FROM {MARKS})"
