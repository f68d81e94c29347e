"""Extension: governed SQL for two roles, access control inside the retrieval legs, community access and leakage.

Members, grants and communities are derived from the tables: nations are principals, regions and two alliances their groups.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..operators import access, retrieval
from ..plans.governance import Asset, Governor, Principal, Rule
from . import Registry, load
from .retrieval import _ASKED, _COS, asked, corpus

R = Registry()


def _own_region(df, who, table):
    nations = table("nation").filter(F.col("n_regionkey").isin(*who.attributes.get("regions", ()))).select(F.col("n_nationkey").alias("c_nationkey"))
    return df.join(nations, "c_nationkey", "left_semi")


def _own_orders(df, who, table):
    return df.join(_own_region(table("customer"), who, table).select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")


ASSETS = [
    Asset("customer", "internal", "sales", {"c_name": frozenset({"person"}), "c_acctbal": frozenset({"money"})}, rows=_own_region),
    Asset("orders", "confidential", "sales", {"o_totalprice": frozenset({"money"})}, rows=_own_orders),
    Asset("nation", "public"),
    Asset("supplier", "restricted", "purchasing"),
]
RULES = {"clerk": Rule({"person": "stars", "money": "null"}), "analyst": Rule({"person": "hash"}), "auditor": Rule({}, all_rows=True)}
CLERK = Principal("clerk", frozenset({"clerk"}), "internal", frozenset({"sales"}), {"regions": (1, 2)})
ANALYST = Principal("analyst", frozenset({"analyst"}), "confidential", attributes={"regions": (0, 3)})
AUDITOR = Principal("auditor", frozenset({"auditor"}), "restricted")


def governor(spark, d):
    return Governor(spark, lambda s, name: load(s, d, name), ASSETS, RULES)


#: One statement for all roles: a common table expression, aliases, a join, two subqueries.
STATEMENT = """WITH done AS (SELECT o.o_custkey AS k, count(*) AS n, round(sum(o.o_totalprice), 2) AS paid FROM orders o WHERE o.o_orderstatus = 'F' GROUP BY o.o_custkey)
SELECT x.c_custkey, x.c_name AS who, x.c_acctbal AS balance, x.c_mktsegment, done.n, done.paid, (SELECT count(*) FROM orders) AS seen
FROM customer x JOIN done ON done.k = x.c_custkey WHERE x.c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _as(name: str, price: str, regions: tuple | None, balance: str) -> str:
    """The statement over the tables as a role sees them."""
    mine = f"WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN {regions})" if regions else ""
    return f"""WITH c AS (SELECT c_custkey, {name} AS c_name, {balance} AS c_acctbal, c_mktsegment FROM customer {mine}),
o AS (SELECT o_custkey, o_orderstatus, o_orderpriority, {price} AS o_totalprice FROM orders SEMI JOIN c ON o_custkey = c_custkey),
done AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS paid FROM o WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey, c_name AS who, c_acctbal AS balance, c_mktsegment, n, paid, (SELECT count(*) FROM o) AS seen FROM c JOIN done ON k = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM o WHERE o_orderpriority = '1-URGENT')"""


@R.add("governed_clerk", _as("'***'", "CAST(NULL AS DOUBLE)", (1, 2), "CAST(NULL AS DOUBLE)"))
def governed_clerk(spark, d):
    return governor(spark, d).query(CLERK, STATEMENT)


@R.add("governed_analyst", _as("sha256(c_name)", "o_totalprice", (0, 3), "c_acctbal"))
def governed_analyst(spark, d):
    return governor(spark, d).query(ANALYST, STATEMENT)


@R.add("governed_auditor", _as("c_name", "o_totalprice", None, "c_acctbal"))
def governed_auditor(spark, d):
    return governor(spark, d).query(AUDITOR, STATEMENT)


# --- groups and grants ---

_MEMBERS = """SELECT 'n' || CAST(n_nationkey AS {t}) AS member, 'r' || CAST(n_regionkey AS {t}) AS grp FROM nation
UNION ALL SELECT 'r' || CAST(r_regionkey AS {t}), CASE WHEN r_regionkey < 2 THEN 'west' ELSE 'east' END FROM region
UNION ALL SELECT DISTINCT CASE WHEN r_regionkey < 2 THEN 'west' ELSE 'east' END, 'staff' FROM region
UNION ALL SELECT 'staff', 'east' FROM region WHERE r_regionkey = 0"""
_GRANTS = """SELECT DISTINCT source, 'r' || CAST(CAST(substr(source, 4) AS INT) % 5 AS {t}) AS grp FROM documents
UNION SELECT DISTINCT source, 'east' FROM documents WHERE source IN ('src0', 'src7', 'src12') UNION SELECT DISTINCT source, 'n2' FROM documents WHERE source = 'src3'"""
_PRINCIPALS = "SELECT 'n' || CAST(n_nationkey AS {t}) AS principal FROM nation"
_ACL = f"""m AS ({_MEMBERS.format(t='VARCHAR')}), g AS ({_GRANTS.format(t='VARCHAR')}),
cl(member, grp) AS (SELECT member, grp FROM m UNION SELECT cl.member, m.grp FROM cl JOIN m ON m.member = cl.grp),
own AS (SELECT member AS principal, grp FROM cl UNION SELECT principal, principal FROM ({_PRINCIPALS.format(t='VARCHAR')})),
may AS (SELECT DISTINCT principal, source FROM own JOIN g USING (grp) JOIN ({_PRINCIPALS.format(t='VARCHAR')}) USING (principal))"""


def _tables(spark, d):
    for name in ("nation", "region", "documents"):
        load(spark, d, name).createOrReplaceTempView(name)
    return tuple(spark.sql(x.format(t="STRING")) for x in (_MEMBERS, _GRANTS, _PRINCIPALS))


def _may(spark, d):
    members, grants, principals = _tables(spark, d)
    return access.allowed(principals, members, grants)


@R.add("group_closure", f"WITH RECURSIVE {_ACL} SELECT member, grp FROM cl")
def group_closure(spark, d):
    return access.closure(_tables(spark, d)[0])


@R.add("acl_sources", f"WITH RECURSIVE {_ACL} SELECT principal, source FROM may")
def acl_sources(spark, d):
    return _may(spark, d)


_WHO = "'n' || CAST((qid // 20) % 25 AS VARCHAR)"


def _found(restricted: bool) -> str:
    only = "JOIN may ON may.principal = q.principal AND may.source = d.source" if restricted else ""
    x = "r" if restricted else "o"
    return rf"""{x}vec AS (SELECT * FROM (SELECT q.qid, b.vec_id AS id, row_number() OVER (PARTITION BY q.qid ORDER BY {_COS} DESC, b.vec_id) AS rank FROM q JOIN embeddings a ON a.vec_id = q.qid CROSS JOIN embeddings b {"JOIN documents d ON d.doc_id = b.vec_id " + only if restricted else ""}) WHERE rank <= 20),
{x}score AS (SELECT q.qid, d.doc_id AS id, round(count(*) * CAST(0.1 AS DOUBLE), 6) AS score FROM toks d JOIN terms USING (term) JOIN q ON q.qid = terms.qid {only} GROUP BY q.qid, d.doc_id),
{x}kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {x}score) WHERE rank <= 20),
{x}legs AS (SELECT qid, id, rank, 0 AS leg FROM {x}vec UNION ALL SELECT qid, id, rank, 1 FROM {x}kw),
{x}fused AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(leg * 1000 + rank) AS first FROM {x}legs GROUP BY qid, id),
{x}best AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank FROM {x}fused)"""


_Q = rf"""q AS (SELECT qid, query, {_WHO} AS principal FROM ({_ASKED})), terms AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS term FROM q),
toks AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM documents)"""


def _questions(spark, d):
    return asked(spark, d).withColumn("principal", F.concat(F.lit("n"), ((F.col("qid") / 20).cast("long") % 25).cast("string")))


def _hybrid(spark, d):
    members, grants, _ = _tables(spark, d)
    v, c = corpus(spark, d)
    return access.hybrid(v, c, _questions(spark, d), members, grants, Settings(top_k_final=10), digits=6)


@R.add("acl_hybrid", f"WITH RECURSIVE {_ACL}, {_Q}, {_found(True)} SELECT qid, principal, id, score, CAST(rank AS INTEGER) AS rank FROM rbest JOIN q USING (qid) WHERE rank <= 10")
def acl_hybrid(spark, d):
    return _hybrid(spark, d).join(_questions(spark, d).select("qid", "principal"), "qid").select("qid", "principal", "id", "score", "rank")


@R.add(
    "acl_leakage",
    f"""WITH RECURSIVE {_ACL}, {_Q}, {_found(True)}, {_found(False)},
x AS (SELECT 'governed' AS system, principal, source FROM rbest JOIN q USING (qid) JOIN documents ON doc_id = id WHERE rank <= 10 UNION ALL SELECT 'open', principal, source FROM obest JOIN q USING (qid) JOIN documents ON doc_id = id WHERE rank <= 10)
SELECT system, principal, count(*) AS n, CAST(count(*) - count(may.source) AS BIGINT) AS leaks FROM x LEFT JOIN may USING (principal, source) GROUP BY system, principal""",
)
def acl_leakage(spark, d):
    """The governed search has no leaks; the same search without access control is the planted leak that the measure must find."""
    v, c = corpus(spark, d)
    q, may, out = _questions(spark, d), _may(spark, d), None
    for name, found in (("governed", _hybrid(spark, d)), ("open", retrieval.hybrid(v, c, q, Settings(top_k_final=10), digits=6))):
        cited = found.join(q.select("qid", "principal"), "qid").join(c.select("id", "source"), "id")
        x = access.leakage(cited, may).select(F.lit(name).alias("system"), "principal", "n", "leaks")
        out = x if out is None else out.unionByName(x)
    return out


@R.add("acl_false_denials", f"WITH RECURSIVE {_ACL}, {_Q}, {_found(True)}, rel AS (SELECT qid, id, principal, source FROM rvec JOIN q USING (qid) JOIN documents ON doc_id = id WHERE rank <= 5), f AS (SELECT qid, id FROM rbest WHERE rank <= 10) SELECT principal, count(*) AS readable, count(f.id) AS found FROM rel JOIN may USING (principal, source) LEFT JOIN f USING (qid, id) GROUP BY principal")
def acl_false_denials(spark, d):
    """Of the five nearest readable vectors of each question, those that the governed search returns."""
    members, grants, _ = _tables(spark, d)
    v, c = corpus(spark, d)
    q = _questions(spark, d)
    near = access.hybrid(v, c, q, members, grants, Settings(mode="vector", top_k_final=5), digits=6)
    relevant = near.select("qid", "id").join(q.select("qid", "principal"), "qid").join(c.select("id", "source"), "id")
    return access.false_denials(relevant, _hybrid(spark, d), _may(spark, d)).select("principal", "readable", "found")


@R.add(
    "acl_communities",
    f"""WITH RECURSIVE {_ACL}, c AS (SELECT DISTINCT doc_id // 2 AS community, source FROM documents)
SELECT principal, community FROM (SELECT community, count(*) AS need FROM c GROUP BY community) JOIN (SELECT principal, community, count(*) AS have FROM c JOIN may USING (source) GROUP BY principal, community) USING (community) WHERE have = need""",
)
def acl_communities(spark, d):
    c = load(spark, d, "documents").select((F.col("doc_id") / 2).cast("long").alias("community"), "source")
    return access.visible_communities(c, _may(spark, d))
