import time

import pytest

from sievewell.config import Settings
from sievewell.plans import schema, sql_gate
from sievewell.plans.clients import HashingEmbedder
from sievewell.sources import catalog


@pytest.mark.parametrize(
    "reply",
    [
        "DELETE FROM sales", "WITH a AS (SELECT 1) INSERT INTO sales SELECT * FROM a", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('a', 'b')",
        "SELECT * FROM parquet.`/etc/passwd`", "SELECT 1 WHERE 1 IN (SELECT reflect('a', 'b'))", "SELECT * FROM text.`/x`", "TABLE sales", "", "no statement", "WITH a AS (SELECT * FROM csv.`/x`) SELECT * FROM a",
        "SELECT * FROM sales WHERE EXISTS (SELECT try_reflect('a', 'b'))",
    ],
)
def test_refused(spark, reply):
    with pytest.raises(sql_gate.UnsafeSQL):
        sql_gate.safe_select(spark, reply)


@pytest.mark.parametrize(
    ("reply", "sql"),
    [
        ("```sql\nSELECT 1\n```", "SELECT 1"), ("Here you are: SELECT a FROM sales; DROP TABLE sales", "SELECT a FROM sales"), ("With pleasure: SELECT 1", "SELECT 1"), ("SELECT 'a;b' AS x", "SELECT 'a;b' AS x"), ("SELECT replace(a, 'delete', 'x') FROM sales", "SELECT replace(a, 'delete', 'x') FROM sales"),
        ("WITH a AS (SELECT 1 AS x) SELECT x FROM a", "WITH a AS (SELECT 1 AS x) SELECT x FROM a"),
    ],
)
def test_accepted(spark, reply, sql):
    assert sql_gate.safe_select(spark, reply) == sql


def test_strict():
    assert sql_gate.safe_select_strict("SELECT a FROM t LIMIT 500", 50) == "SELECT a FROM t LIMIT 50"
    assert sql_gate.safe_select_strict("SELECT a FROM t LIMIT 5;", 50) == "SELECT a FROM t LIMIT 5"
    assert sql_gate.safe_select_strict("SELECT created_at FROM t", 50) == "SELECT created_at FROM t LIMIT 50"
    with pytest.raises(sql_gate.UnsafeSQL):
        sql_gate.safe_select_strict("SELECT replace(a, 'x', 'y') FROM t", 50)


def test_run(spark):
    catalog.demo_sales(spark)
    done = sql_gate.run(spark, "SELECT SUM(amount) AS s FROM sales WHERE sold_at >= '2025-01-01' AND sold_at < '2026-01-01'")
    assert done.ok and done.columns == ["s"] and done.rows == [(5600.0,)]
    assert sql_gate.run(spark, "SELECT id FROM sales ORDER BY id LIMIT 5 OFFSET 2", Settings(sql_max_rows=2)).rows == [(3,), (4,)]
    assert "rejected" in sql_gate.run(spark, "DROP TABLE sales").error
    assert "failed" in sql_gate.run(spark, "SELECT nothing FROM sales").error
    assert sql_gate.render(["a", "b"], [(1, None)]) == "a | b\n---\n1 | " and sql_gate.render([], []) == "(no columns)" and sql_gate.render(["a"], []) == "(no rows)"


def test_guards(spark):
    began = time.monotonic()
    done = sql_gate.run(spark, "SELECT sum(CAST(a.id AS DOUBLE) * b.id) AS s FROM range(1000000) a CROSS JOIN range(1000000) b", Settings(sql_timeout_s=1.0))
    assert not done.ok and "exceeded" in done.error and time.monotonic() - began < 30
    catalog.demo_sales(spark)
    assert "scan budget" in sql_gate.run(spark, "SELECT * FROM sales", Settings(sql_scan_budget_bytes=1)).error
    # cancelled tasks may hold their cores for some seconds more
    assert sql_gate.run(spark, "SELECT 1 AS x", Settings(sql_timeout_s=60.0)).rows == [(1,)]


def test_schema(spark):
    catalog.demo_sales(spark)
    assert schema.signature(spark, "sales") == "TABLE sales (id int, region string, product string, amount double, sold_at string)"
    assert schema.describe(spark, ["sales"]).count("id=") == 3
    with pytest.raises(ValueError):
        schema.describe(spark, [])
    sig = {"orders": "TABLE orders (id int, total double)", "employees": "TABLE employees (name string, salary double)", "regions": "TABLE regions (name string)"}
    assert schema.lexical_rank("What is the salary of employees?", sig)[0] == ("employees", 2)
    assert schema.embedding_rank("salary", sig, HashingEmbedder())[0] == "employees"

    def broken(_):
        raise RuntimeError

    assert schema.embedding_rank("salary", sig, broken) is None
    assert schema.narrow(spark, "x", 8, broken, ["a", "b"]) == ["a", "b"]
    assert schema.fuse_names([["a", "b"], ["b", "a"]]) == ["a", "b"]
