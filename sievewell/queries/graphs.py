"""Graph operators. Entities come from ``part``, edges from parts of equal brand, communities from nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..plans import engine
from . import Registry, load

R = Registry()

_ENT = "SELECT p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN '  ' || p_brand || ' ' ELSE lower(p_brand) END AS name, p_type AS type, p_name AS description, p_partkey AS chunk_id FROM part"


def raw_entities(spark, d):
    load(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(_ENT)


def entities(spark, d):
    return graph.merge_entities(raw_entities(spark, d), "ord")


_MERGED = rf"""e AS (SELECT *, regexp_replace(lower(regexp_replace(name, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS key FROM ({_ENT})),
m AS (SELECT key, min_by(name, ord) AS name, min_by(type, ord) AS type, max_by(description, (length(description), -ord)) AS description, list_sort(list_distinct(list(chunk_id))) AS chunk_ids FROM e GROUP BY key)"""


@R.add("merge_entities", f"WITH {_MERGED} SELECT key, name, type, description, array_to_string(chunk_ids, ',') AS chunks FROM m")
def merge_entities(spark, d):
    return entities(spark, d).select("key", "name", "type", "description", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunks"))


_RAW = "SELECT l_orderkey AS o, l_linenumber AS n, upper(p_brand) AS source, CASE WHEN l_linenumber % 4 = 0 THEN 'nobody' ELSE ' ' || lower(p_brand) END AS target FROM lineitem JOIN part ON l_partkey = p_partkey"


@R.add("valid_edges", f"WITH {_MERGED}, r AS ({_RAW}) SELECT o, n, lower(trim(source)) AS s, lower(trim(target)) AS t FROM r WHERE lower(trim(source)) IN (SELECT key FROM m) AND lower(trim(target)) IN (SELECT key FROM m)")
def valid_edges(spark, d):
    ents = entities(spark, d)
    load(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return graph.valid_edges(spark.sql(_RAW), ents).select("o", "n", "s", "t")


_EDGES = "SELECT p_partkey AS a, p_partkey + 61 * p_size AS b FROM part"


@R.add(
    "components",
    f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_EDGES}) WHERE a <> b UNION SELECT b, a FROM ({_EDGES}) WHERE a <> b),
r(id, seen) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT id, min(seen) AS component FROM r GROUP BY id""",
)
def components(spark, d):
    load(spark, d, "part").createOrReplaceTempView("part")
    return graph.components(spark.sql(_EDGES))


@R.add("communities")
def communities(spark, d):
    load(spark, d, "part").createOrReplaceTempView("part")
    return graph.communities(spark.sql(_EDGES))


@R.add("label_propagation")
def label_propagation(spark, d):
    load(spark, d, "part").createOrReplaceTempView("part")
    return graph.label_propagation(spark.sql(_EDGES), 10)


@R.add(
    "provenance",
    f"""WITH {_MERGED}, x AS (SELECT key, CAST(substr(key, length(key), 1) AS INTEGER) % 3 AS community, unnest(chunk_ids) AS chunk_id FROM m),
s AS (SELECT DISTINCT community, 'src' || CAST(s_nationkey AS VARCHAR) AS source FROM x JOIN supplier ON s_suppkey = chunk_id)
SELECT community, string_agg(source, ',' ORDER BY source) AS sources FROM s GROUP BY community""",
)
def provenance(spark, d):
    ents = entities(spark, d)
    members = ents.select((F.substring("key", -1, 1).cast("int") % 3).alias("community"), F.col("key").alias("id"))
    chunks = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("src"), F.col("s_nationkey").cast("string")).alias("source"))
    return graph.provenance(members, ents, chunks).select("community", F.array_join("sources", ",").alias("sources"))


@R.add(
    "community_facts",
    f"""WITH {_MERGED}, c AS (SELECT key, CAST(substr(key, length(key), 1) AS INTEGER) % 3 AS community FROM m),
r AS (SELECT DISTINCT lower(trim(source)) AS s, lower(trim(target)) AS t, source, target FROM ({_RAW})),
n AS (SELECT community, string_agg('- ' || name || ' (' || type || '): ' || description, chr(10) ORDER BY '- ' || name || ' (' || type || '): ' || description) AS members FROM c JOIN m USING (key) GROUP BY community),
l AS (SELECT a.community, string_agg(DISTINCT '- ' || source || ' → ' || target || ': sold', chr(10) ORDER BY '- ' || source || ' → ' || target || ': sold') AS links FROM r JOIN c a ON a.key = s JOIN c b ON b.key = t AND a.community = b.community GROUP BY a.community)
SELECT community, 'Entities:' || chr(10) || members || chr(10) || 'Relationships:' || chr(10) || coalesce(links, '(none)') AS facts FROM n LEFT JOIN l USING (community)""",
)
def community_facts(spark, d):
    ents = entities(spark, d)
    load(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    edges = graph.valid_edges(spark.sql(_RAW).withColumn("description", F.lit("sold")).drop("o", "n").distinct(), ents)
    members = ents.select((F.substring("key", -1, 1).cast("int") % 3).alias("community"), F.col("key").alias("id"))
    return engine.community_facts(members, ents, edges).select("community", "facts")


_COMM = """SELECT r_regionkey AS id, 'Nations of ' || r_name AS summary, list_sort(list(n_name)) AS entity_names, list_sort(list_distinct(list('src' || CAST(n_nationkey % 7 AS VARCHAR)))) AS sources FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
UNION ALL SELECT 100 + n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Only ' || n_name ELSE NULL END, [n_name], CASE WHEN n_nationkey % 5 = 0 THEN [] ELSE ['src' || CAST(n_nationkey AS VARCHAR)] END FROM nation"""


def comms(spark, d):
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    s = lambda c: F.concat(F.lit("src"), c.cast("string"))
    groups = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list("n_name")).alias("entity_names"), F.array_sort(F.collect_set(s(F.col("n_nationkey") % 7))).alias("sources"))
    many = groups.select(F.col("r_regionkey").alias("id"), F.concat(F.lit("Nations of "), "r_name").alias("summary"), "entity_names", "sources")
    k = F.col("n_nationkey")
    one = n.select((k + 100).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("Only "), "n_name")).alias("summary"), F.array("n_name").alias("entity_names"), F.when(k % 5 == 0, F.expr("array()").cast("array<string>")).otherwise(F.array(s(k))).alias("sources"))
    return many.unionByName(one)


LIVE = ["src1", "src2", "src11"]
_LIVE = "['src1', 'src2', 'src11']"


@R.add("rebuild_filter", f"SELECT id, array_to_string(CASE WHEN len(sources) = 0 THEN sources ELSE [x FOR x IN sources IF list_contains({_LIVE}, x)] END, ',') AS sources FROM ({_COMM}) WHERE len(sources) = 0 OR len([x FOR x IN sources IF list_contains({_LIVE}, x)]) > 0")
def rebuild_filter(spark, d):
    live = spark.createDataFrame([(x,) for x in LIVE], "source string")
    return graph.rebuild(comms(spark, d), live).select("id", F.array_join("sources", ",").alias("sources"))


@R.add("community_select", f"SELECT id, CAST(len(entity_names) AS INTEGER) AS size FROM ({_COMM}) WHERE summary <> '' AND len(entity_names) >= 2 AND (len(sources) = 0 OR len([x FOR x IN sources IF list_contains({_LIVE}, x)]) > 0) ORDER BY size DESC, id LIMIT 8")
def community_select(spark, d):
    return graph.select_by_size(comms(spark, d), live=LIVE).select("id", "size")


_COS = "list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


@R.add("community_rank", f"SELECT v.vec_id AS id, round({_COS}, 6) AS score FROM embeddings v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE v.vec_id % 9 <> 0 AND v.label IN (1, 2, 3) ORDER BY {_COS} DESC, id LIMIT 8")
def community_rank(spark, d):
    e = load(spark, d, "embeddings")
    q = e.filter("vec_id = 3").first().embedding
    c = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 9 == 0, F.expr("array()").cast("array<float>")).otherwise(F.col("embedding")).alias("embedding"), F.array(F.col("label").cast("string")).alias("sources"))
    return graph.rank_communities(c, q, 8, ["1", "2", "3"]).select("id", F.round("score", 6).alias("score"))


@R.add("stale_sources", f"SELECT DISTINCT s AS source FROM (SELECT unnest(sources) AS s FROM ({_COMM})) WHERE NOT list_contains({_LIVE}, s)")
def stale_sources(spark, d):
    return graph.stale_sources(comms(spark, d), spark.createDataFrame([(x,) for x in LIVE], "source string"))


_QUESTION = "How are the nations UNITED KINGDOM and saudi arabia of Asia linked to the NATION_1 and nation_2?"


@R.add(
    "local_search_rank",
    r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower('How are the nations UNITED KINGDOM and saudi arabia of Asia linked to the NATION_1 and nation_2?'), '[\p{L}\p{N}_]+')) AS t),
e AS (SELECT n_name, (SELECT count(*) FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(n_name), '[\p{L}\p{N}_]+')) AS x) JOIN t ON x = t WHERE length(x) > 2) AS shared FROM nation)
SELECT n_name AS name, CAST(shared AS INTEGER) AS shared FROM e WHERE shared > 0 ORDER BY shared DESC, lower(n_name) LIMIT 5""",
)
def local_search_rank(spark, d):
    n = load(spark, d, "nation").select(F.col("n_name").alias("name"), F.lower("n_name").alias("key"))
    edges = load(spark, d, "nation").select(F.col("n_name").alias("source"), F.col("n_regionkey").cast("string").alias("target"))
    return graph.local_search(n, edges, _QUESTION)[0].select("name", "shared")


@R.add("acl_filter", "SELECT doc_id FROM documents WHERE source IN ('src0', 'src3')")
def acl_filter(spark, d):
    """Extension: what a user may see, applied before any leg ranks."""
    allowed = spark.createDataFrame([("src0",), ("src3",)], "source string")
    return load(spark, d, "documents").join(F.broadcast(allowed), "source", "left_semi").select("doc_id")
