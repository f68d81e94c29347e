import pytest
from pyspark.sql import functions as F

from sievewell.config import Settings
from sievewell.operators import access
from sievewell.plans.governance import Asset, Denied, Governor, Principal, Rule
from sievewell.plans.sql_gate import UnsafeSQL
from sievewell.queries import governance as q

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staff(spark):
    people = [(1, "Ann", "ann@x", 100, "APAC"), (2, "Bob", "bob@x", 200, "EMEA"), (3, None, "c@x", 300, "APAC"), (4, "Dan", None, None, None)]
    tables = {"people": (people, "id int, name string, mail string, salary int, region string"), "teams": ([(1, "ops"), (2, "ops"), (3, "dev")], "person int, team string"), "secrets": ([(1,)], "x int")}
    load = lambda s, t: s.createDataFrame(*tables[t])
    by_region = lambda df, who, _: df.filter(F.col("region") == who.attributes["region"])
    assets = [Asset("people", "internal", "hr", {"name": frozenset({"person"}), "mail": frozenset({"person"}), "salary": frozenset({"money"})}, frozenset({"mail"}), by_region), Asset("teams", "public"), Asset("secrets", "restricted", "board")]
    return Governor(spark, load, assets, {"analyst": Rule({"person": "stars", "money": "null"}), "payroll": Rule({"person": "hash"}), "boss": Rule({}, True)})


ANALYST = Principal("ana", frozenset({"analyst"}), "internal", attributes={"region": "APAC"})
BOSS = Principal("boss", frozenset({"boss"}), "restricted")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM people", "SELECT p.id, p.name, p.salary, p.region FROM people AS p", "WITH x AS (SELECT * FROM people) SELECT * FROM (SELECT * FROM x) y", "SELECT * FROM people UNION SELECT * FROM people",
        "SELECT id, name, salary, region FROM people WHERE id IN (SELECT id FROM people)", "SELECT a.* FROM people a JOIN people b ON a.id = b.id",
    ],
)
def test_masks_and_rows(staff, sql):
    if "UNION" in sql:
        sql = sql.replace("UNION", "UNION ALL") + " LIMIT 2"
    got = rows(staff.query(ANALYST, sql))
    assert got == [(1, "***", None, "APAC"), (3, None, None, "APAC")]
    assert len(rows(staff.query(BOSS, sql))) == (2 if "LIMIT" in sql else 4)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT id FROM people WHERE salary > 150", "SELECT id FROM people p WHERE p.name LIKE 'A%'", "WITH x AS (SELECT id, salary AS s FROM people) SELECT id FROM x WHERE s = 100", "SELECT a.id FROM people a JOIN teams t ON a.name = t.team",
        "SELECT count(*) FROM people GROUP BY salary", "SELECT id FROM people ORDER BY name", "SELECT row_number() OVER (PARTITION BY region ORDER BY salary) FROM people", "SELECT person FROM teams WHERE EXISTS (SELECT 1 FROM people WHERE id = person AND salary > 1)",
        "SELECT person FROM teams WHERE team IN (SELECT name FROM people)", "SELECT id FROM (SELECT id, salary + 0 AS z FROM people) WHERE z > 1", "SELECT id FROM people WHERE (SELECT max(salary) FROM people) > 1", "SELECT max(id) FROM people GROUP BY region HAVING max(salary) > 1",
        "SELECT name FROM people EXCEPT SELECT team FROM teams", "SELECT DISTINCT salary FROM people", "SELECT mail FROM people", "SELECT id FROM people WHERE mail IS NULL", "SELECT * FROM secrets", "SELECT id FROM people JOIN secrets ON id = x", "SELECT id FROM people WHERE id = (SELECT x FROM secrets)",
        "SELECT id FROM people p, LATERAL (SELECT team FROM teams WHERE team = p.name)", "SELECT id FROM people WHERE CASE WHEN salary > 5 THEN true ELSE false END",
        "SELECT * FROM unknown", "SELECT * FROM parquet.`/etc/passwd`", "DROP TABLE people", "SELECT * FROM global_temp.people", "SELECT * FROM default.people",
    ],
)
def test_refused(staff, sql):
    with pytest.raises(UnsafeSQL):
        staff.query(ANALYST, sql)
    assert staff.run(ANALYST, sql).error.startswith("refused")


def test_other_tables_are_out_of_reach(spark, staff):
    spark.range(3).createOrReplaceGlobalTempView("gov_leak")
    spark.range(3).createOrReplaceTempView("gov_leak_local")
    for name in ("global_temp.gov_leak", "gov_leak_local"):
        with pytest.raises(Denied):
            staff.query(ANALYST, f"SELECT * FROM {name}")
    assert not spark.catalog.tableExists("people")  # the views are the principal's alone


def test_roles(staff):
    both = Principal("pam", frozenset({"analyst", "payroll"}), "internal", attributes={"region": "EMEA"})
    assert rows(staff.query(both, "SELECT name, salary FROM people WHERE salary > 1")) == [("***", 200)]  # one of the roles sees money
    team = Principal("hr", frozenset({"analyst"}), "public", frozenset({"hr"}), {"region": "EMEA"})
    assert rows(staff.query(team, "SELECT id FROM people")) == [(2,)]
    for nobody in (Principal("x", frozenset({"analyst"}), "public"), Principal("y", frozenset({"unknown"}), "restricted")):
        assert "people" not in staff.schema(nobody)
    assert staff.schema(ANALYST) == {"people": ["id", "name", "salary", "region"], "teams": ["person", "team"]}


def test_lineage(staff):
    df = staff.query(ANALYST, "WITH x AS (SELECT id AS k, salary * 2 AS d, region FROM people) SELECT x.d + t.person AS s, upper(t.team) AS u, count(*) OVER (PARTITION BY x.region) AS n, (SELECT max(team) FROM teams) AS m FROM x JOIN teams t ON t.person = x.k")
    got = staff.lineage(df)
    assert got.outputs["s"] == {("people", "salary"), ("teams", "person")} and got.outputs["u"] == got.outputs["m"] == {("teams", "team")}
    assert got.conditions == {("people", "id"), ("teams", "person"), ("people", "region")}
    union = staff.query(BOSS, "SELECT name AS a FROM people UNION ALL SELECT team FROM teams")
    assert staff.lineage(union).outputs["a"] == {("people", "name"), ("teams", "team")}


def test_filters_reach_the_scan(spark):
    plan = q.governor(spark, FOLDER).query(q.AUDITOR, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "c_acctbal" not in plan


def test_run(staff):
    done = staff.run(ANALYST, "Sure: ```sql\nSELECT id, name FROM people```")
    assert done.ok and sorted(done.rows) == [(1, "***"), (3, None)]
    assert staff.run(ANALYST, "SELECT 1 / (id - 1) FROM people").error == "SQL execution failed"


def test_closure(spark):
    members = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "b"), ("e", "b"), (None, "a"), ("f", None)], "member string, grp string")
    assert rows(access.closure(members)) == sorted([(m, g) for m in "abce" for g in "abc"] + [("d", "d")])
    assert access.closure(members.limit(0)).count() == 0


def test_hidden_rows_change_nothing(spark):
    """The search gives what it would give if unreadable rows did not exist."""
    members, grants, _ = q._tables(spark, FOLDER)
    v, c = q.corpus(spark, FOLDER)
    ask = q._questions(spark, FOLDER).filter("principal = 'n0'")
    assert ask.count() > 0
    may = q._may(spark, FOLDER).filter("principal = 'n0'")
    mine = c.join(may, "source", "left_semi")
    assert 0 < mine.count() < c.count()
    run = lambda v, c: rows(access.hybrid(v, c, ask, members, grants, Settings(top_k_final=40), digits=6))
    assert run(v, c) == run(v.join(mine.select("id"), "id", "left_semi"), mine) != []


def test_leakage(spark):
    got = {(r.system, r.principal): r for r in q.acl_leakage(spark, FOLDER).collect()}
    assert all(r.leaks == 0 for k, r in got.items() if k[0] == "governed") and any(r.leaks > 0 for k, r in got.items() if k[0] == "open")
    may = spark.createDataFrame([("p", "s1"), ("p", "s1")], "principal string, source string")
    cited = spark.createDataFrame([("p", "s1"), ("p", "s2"), ("p", None), ("x", "s1")], "principal string, source string")
    assert {r.principal: (r.n, r.leaks) for r in access.leakage(cited, may).collect()} == {"p": (3, 2), "x": (1, 1)}
    results = spark.createDataFrame([(1, 10)], "qid int, id int")
    relevant = spark.createDataFrame([("p", 1, 10, "s1"), ("p", 1, 11, "s1"), ("p", 1, 12, "s2")], "principal string, qid int, id int, source string")
    assert [tuple(r) for r in access.false_denials(relevant, results, may).collect()] == [("p", 2, 1, 0.5)]


def test_communities(spark):
    c = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None), (3, "a"), (4, "z")], "community int, source string")
    may = spark.createDataFrame([("p", "a"), ("p", "b"), ("r", "a"), ("r", "a")], "principal string, source string")
    assert rows(access.visible_communities(c, may)) == [("p", 1), ("p", 2), ("r", 2)]
