"""The guard of read-only SQL: what the grammar has runs, and no spelling reaches anything else."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from attestra.plans import guarded_sql

JAVA = "('java.lang.System','getProperty','java.version')"


@pytest.mark.parametrize("sql", [
    f'SELECT "--" , java_method{JAVA} FROM records', f"SELECT `--` , reflect{JAVA} FROM records", f"SELECT `/*`, reflect{JAVA} AS `*/` FROM records", f"SELECT '\\' , reflect{JAVA} FROM records",
    f"SELECT 1 AS java_method, java_method{JAVA} AS x FROM records", f"SELECT 1 AS reflect, `reflect`{JAVA} AS x FROM records", f"SELECT 1 AS try_reflect, try_reflect{JAVA} AS x FROM records",
    "SELECT 1 AS input_file_name, input_file_name() AS x FROM records", "SELECT /* a /* b */ c FROM records", "SELECT 1 AS range, x.id AS id FROM range(3) AS x",
    "SELECT 1 AS explode, explode(array(1)) AS array FROM records", "SELECT 1 AS version, version() AS x FROM records", "SELECT 1 AS current_user, current_user AS z FROM records",
    f"SELECT 1 AS n WHERE 1 IN (SELECT 1 AS reflect FROM records WHERE reflect{JAVA} IS NULL)", f"SELECT n, row_number() OVER (ORDER BY reflect{JAVA} DESC) AS reflect FROM records",
    "SELECT n FROM records) t JOIN (SELECT 1", "SELECT n FROM records; SELECT 1", "SELECT n FROM parquet.`/tmp`", "SELECT 'a", 'SELECT "a', "SELECT `a", "SELECT n -- x\n; DROP TABLE records",
])
def test_no_spelling_passes(spark, sql):
    rows = spark.createDataFrame([("a", 3)], "name string, n int")
    with pytest.raises(guarded_sql.Refused):
        guarded_sql.run(rows, sql)


def test_what_the_grammar_has_runs(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("b", 1, "y"), (None, 2, "z")], "name string, n int, `odd col` string").withColumn("m", F.sha2("name", 256))
    one = lambda sql: [tuple(r) for r in guarded_sql.run(rows, sql).collect()]
    assert one('SELECT "odd col" AS o FROM records') == [("x",), ("y",), ("z",)]
    nested = "WITH t AS (SELECT name, count(*) AS c FROM records GROUP BY name) SELECT c, name FROM t WHERE c IN (SELECT min(n) FROM records) AND EXISTS (SELECT 1 FROM records AS b WHERE b.name = t.name)"
    assert sorted(one(nested)) == [(1, "a"), (1, "b")]
    assert one(
        "SELECT floor(avg(n)) AS a, round(1.25, 1) AS r, ceil(2.5) AS c, mod(max(n), 2) AS o, left(min(name), 1) AS l, nullif(1, 1) AS k, greatest(1, 2) AS g, least(1, 2) AS e, trim(' x ') AS t, substring('abc', 2, 1) AS s, "
        "coalesce(NULL, 'x') || 'y' AS z, abs(-1) AS b, CASE WHEN count(n) BETWEEN 1 AND 3 THEN 'in' ELSE 'out' END AS w, upper('q') AS u, cast('5' AS int) AS i FROM records"
    ) == [(2, Decimal("1.3"), 3, 1, "a", None, 2, 1, "x", "b", "xy", 1, "in", "Q", 5)]
    assert len(one("SELECT DISTINCT name FROM records UNION ALL SELECT name FROM records EXCEPT SELECT name FROM records WHERE name LIKE 'a%' OR name ILIKE 'B'")) == 1
    assert one("SELECT sum(n) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, m IS NULL AS q FROM records ORDER BY s LIMIT 2 OFFSET 1") == [(3, True), (6, False)]


def test_the_statement_is_written_anew():
    assert guarded_sql.validate("SELECT 'b''c' --d\n, \"n\"/*f/*g*/h*/ ; ", ["n"]) == "SELECT 'b''c' , `n`"


def test_a_view_beside_the_relation_is_refused(spark):
    rows = spark.createDataFrame([("a", 3)], "name string, n int")
    spark.createDataFrame([("z", 9)], "name string, n int").createOrReplaceTempView("name")
    with pytest.raises(guarded_sql.Refused):
        guarded_sql.run(rows, "SELECT * FROM name")
    spark.catalog.dropTempView("name")
