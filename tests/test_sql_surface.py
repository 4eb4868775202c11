"""Read-only SQL: what is refused and what is not."""

import pytest

from revlake.plans import sqlsurface


@pytest.fixture
def numbers(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t")
    sqlsurface.register({"numbers": spark.range(5)})
    spark.range(3).createOrReplaceTempView("unlisted")
    return str(tmp_path)


COLUMNS = ", ".join(f"id AS c{k}" for k in range(40))
REFUSED = [
    "", "DROP VIEW numbers", "INSERT INTO numbers VALUES (1)", "WITH x AS (SELECT 1) DELETE FROM numbers", "SET spark.x = 1", "EXPLAIN SELECT 1", "SHOW TABLES", "SELECT 1; SELECT 2",
    "SELECT * FROM parquet.`{at}/t`", "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM unlisted", "SELECT * FROM global_temp.numbers", "SELECT * FROM spark_catalog.default.numbers",
    "SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/hostname`", "SELECT * FROM `org.apache.spark.sql.execution.datasources.v2.text.TextDataSourceV2`.`/etc/hostname`",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')", "SELECT id FROM numbers WHERE reflect('java.lang.Math', 'abs', -1) = '1'", "SELECT try_reflect('java.lang.Math', 'abs', -1)",
    f"SELECT {COLUMNS}, `java_method`('java.lang.System', 'getProperty', 'user.dir') FROM numbers", "SELECT java_method /**/ ('java.lang.System', 'getProperty', 'user.dir')", "SELECT `java_method` /* x */ ('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT id FROM numbers ORDER BY reflect('java.lang.Math', 'abs', id)", "SELECT sum(id) FILTER (WHERE reflect('java.lang.Math', 'abs', -1) = '1') FROM numbers", "SELECT max(id) OVER w FROM numbers WINDOW w AS (ORDER BY reflect('java.lang.Math', 'abs', id))",
    "SELECT transform(array(1), x -> reflect('java.lang.Math', 'abs', x))", "SELECT * FROM numbers LATERAL VIEW explode(array(reflect('java.lang.Math', 'abs', id))) t AS x", "SELECT CASE WHEN true THEN reflect('java.lang.Math', 'abs', -1) END",
    "SELECT * FROM numbers WHERE EXISTS (SELECT 1 FROM text.`/etc/hostname`)", "SELECT (SELECT max(value) FROM text.`/etc/hostname`)", "SELECT * FROM numbers WHERE id IN (SELECT value FROM text.`/etc/hostname`)",
    "WITH a AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM a", "SELECT * FROM unlisted, (WITH unlisted AS (SELECT 1) SELECT * FROM unlisted) AS t", "SELECT input_file_name() FROM numbers", "SELECT current_user(), version()",
    "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.dir')", "SELECT * FROM IDENTIFIER('unlisted')", "SELECT system.builtin.java_method('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT TRANSFORM(id) USING 'cat' FROM numbers", "FROM numbers SELECT TRANSFORM(id) USING 'cat' AS (a)", "SELECT * FROM read_files('/etc/hostname')", "TABLE unlisted", "CREATE TABLE t AS SELECT 1", "CACHE TABLE numbers",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, numbers, sql):
    with pytest.raises(ValueError):
        sqlsurface.read_only(spark, sql.replace("{at}", numbers))


@pytest.mark.parametrize(
    ("sql", "n"),
    [
        ("WITH a AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM numbers), b AS (SELECT * FROM a) SELECT * FROM b JOIN numbers USING (id) WHERE id IN (SELECT max(id) FROM numbers) OR id < 2 ORDER BY id LIMIT 9", 3),
        ("SELECT n.id % 2 AS odd, count(*) AS n, sum(n.id) FILTER (WHERE n.id > 0), max(m.id) FROM numbers n LEFT JOIN NUMBERS m ON n.id = m.id + 1 GROUP BY 1 HAVING count(*) > 1 ORDER BY 1", 2),
        ("SELECT max(id) OVER w AS m, sum(id) OVER (PARTITION BY id % 2 ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM numbers WINDOW w AS (ORDER BY id)", 5),
        ("SELECT 'a; b' AS s, -id, CAST(id AS STRING) || 'x', CASE WHEN id BETWEEN 1 AND 2 THEN 'y' ELSE upper('z') END, date_trunc('month', DATE '2024-01-02'), id::double FROM numbers WHERE NOT id = 3 AND 'ab' LIKE 'a%'", 4),
        ("SELECT id FROM numbers UNION ALL SELECT id + 1 FROM numbers EXCEPT SELECT 3", 5),
        ("SELECT t.x, transform(array(1, 2), y -> y + 1)[0] FROM numbers LATERAL VIEW explode(array(id, id)) t AS x WHERE EXISTS (SELECT 1 FROM numbers b WHERE b.id = x)", 10),
        ("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS v(k, s)", 2),
        ("SELECT id, count(*) FROM numbers GROUP BY ROLLUP (id)", 6),
        ("SELECT * FROM range(3) CROSS JOIN (SELECT coalesce(NULL, 1), if(true, 1, 2), named_struct('a', 1).a, to_json(struct(1)), regexp_replace('a', 'b', 'c'))", 3),
        (f"SELECT {COLUMNS} FROM numbers", 5),
        ("SELECT DISTINCT extract(YEAR FROM DATE '2024-01-02'), trim(' a '), substring('abc', 1, 2), position('b' IN 'abc'), id IS NOT NULL, id <=> NULL FROM numbers", 1),
    ],
)
def test_accepted(spark, numbers, sql, n):
    for width in ("1000", "2"):
        spark.conf.set("spark.sql.debug.maxToStringFields", width)
        assert sqlsurface.read_only(spark, sql).count() == n
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_a_registered_function_of_ones_own_is_refused(spark, numbers):
    spark.udf.register("own", lambda: "x")
    with pytest.raises(ValueError):
        sqlsurface.read_only(spark, "SELECT own() FROM numbers")
