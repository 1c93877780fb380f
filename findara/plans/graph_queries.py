"""Queries on the graph, on relevance that spreads over it, and on opportunities.

Customers, suppliers, parts, orders, nations and regions are nodes; an order that has a part from a supplier relates
them, in the role its return flag is.  The results of a search are the orders with the highest price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findara.functions.scores import band
from findara.functions.text import without_suffix
from findara.operators import opportunities as opp
from findara.operators.graph import ForeignKey, Relation, dangling, declared, edges, induced, neighbours, nodes, two_steps
from findara.operators.propagation import best_of, bridged, contributions, matched, spread
from findara.plans.catalog import FACETS, LEXICAL, SQL, query
from findara.plans.score_queries import facet_overlaps
from findara.plans.text_queries import lexical_index
from findara.session import table

#: Weights of the roles; any other has 0.6.
ROLES = {"R": 1.0, "A": 0.8}

NODES = """nodes AS (SELECT 'c' || c_custkey AS id, 'CUSTOMER' AS kind, c_name AS name FROM customer UNION ALL SELECT 's' || s_suppkey, 'SUPPLIER', s_name FROM supplier
    UNION ALL SELECT 'p' || p_partkey, 'PART', p_name FROM part UNION ALL SELECT 'o' || o_orderkey, 'ORDER', o_orderpriority FROM orders
    UNION ALL SELECT 'n' || n_nationkey, 'NATION', n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'REGION', r_name FROM region)"""
KEYS = """keys AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'customer_of_nation' AS label, 0 AS ordinal FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplier_of_nation', 1 FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation_of_region', 2 FROM nation
    UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'order_of_customer', 3 FROM orders)"""
RELATED = """related AS (SELECT 's' || l_suppkey AS src, 'o' || l_orderkey AS dst, 'supplies_order' AS label, l_returnflag AS role, 4 AS ordinal FROM lineitem
    UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'order_has_part', l_linestatus, 5 FROM lineitem)"""
GRAPH = f"""{NODES}, {KEYS}, {RELATED},
    graph AS (SELECT e.* FROM (SELECT src, dst, label, CAST(NULL AS VARCHAR) AS role, ordinal FROM keys UNION ALL SELECT src, dst, label, role, ordinal FROM related) e
              WHERE e.src IN (SELECT id FROM nodes) AND e.dst IN (SELECT id FROM nodes))"""


def _key(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = {n: table(spark, sf_dir, n) for n in ("customer", "supplier", "part", "orders", "nation", "region", "lineitem")}
    known = nodes(
        [("CUSTOMER", t["customer"], _key("c", "c_custkey"), F.col("c_name")), ("SUPPLIER", t["supplier"], _key("s", "s_suppkey"), F.col("s_name")), ("PART", t["part"], _key("p", "p_partkey"), F.col("p_name")),
         ("ORDER", t["orders"], _key("o", "o_orderkey"), F.col("o_orderpriority")), ("NATION", t["nation"], _key("n", "n_nationkey"), F.col("n_name")), ("REGION", t["region"], _key("r", "r_regionkey"), F.col("r_name"))]
    )
    of = lambda df, **c: df.select(*[e.alias(n) for n, e in c.items()])
    keys = [
        ForeignKey(of(t["customer"], id=_key("c", "c_custkey"), to=_key("n", "c_nationkey")), "id", "to", "customer_of_nation", "customer"),
        ForeignKey(of(t["supplier"], id=_key("s", "s_suppkey"), to=_key("n", "s_nationkey")), "id", "to", "supplier_of_nation", "supplier"),
        ForeignKey(of(t["nation"], id=_key("n", "n_nationkey"), to=_key("r", "n_regionkey")), "id", "to", "nation_of_region", "nation"),
        ForeignKey(of(t["orders"], id=_key("o", "o_orderkey"), to=_key("c", "o_custkey")), "id", "to", "order_of_customer", "orders"),
    ]
    lines = t["lineitem"]
    relations = [
        Relation(of(lines, a=_key("s", "l_suppkey"), b=_key("o", "l_orderkey"), role=F.col("l_returnflag")), "a", "b", "role", "supplies_order", "lineitem"),
        Relation(of(lines, a=_key("o", "l_orderkey"), b=_key("p", "l_partkey"), role=F.col("l_linestatus")), "a", "b", "role", "order_has_part", "lineitem"),
    ]
    return known, edges(known, keys, relations)


@query(f"WITH {NODES} SELECT id, kind, name FROM nodes")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_tables(spark, sf_dir)[0]


@query(f"WITH {GRAPH} SELECT src, dst, label FROM graph WHERE ordinal < 4")
def graph_edges_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_tables(spark, sf_dir)[1].filter("ordinal < 4").select("src", "dst", "label")


@query(f"WITH {GRAPH} SELECT src, dst, label, role, count(*) AS parallel FROM graph WHERE ordinal >= 4 GROUP BY ALL")
def graph_edges_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_tables(spark, sf_dir)[1].filter("ordinal >= 4").groupBy("src", "dst", "label", "role").agg(F.count("*").alias("parallel"))


@query(f"WITH {GRAPH} SELECT label, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS destinations FROM graph GROUP BY label")
def edge_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_tables(spark, sf_dir)[1]
    return graph.groupBy("label").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("destinations"))


@query(f"WITH {GRAPH} SELECT dst AS id, label, count(*) AS edges, count(DISTINCT src) AS neighbours FROM graph JOIN nodes n ON n.id = graph.dst AND n.kind = 'ORDER' WHERE label = 'supplies_order' GROUP BY ALL")
def neighbours_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, graph = graph_tables(spark, sf_dir)
    found = neighbours(known.filter("kind = 'ORDER'").select("id"), graph, ["supplies_order"], "in")
    return found.groupBy("id", "label").agg(F.count("*").alias("edges"), F.countDistinct("neighbour").alias("neighbours"))


@query(f"WITH {GRAPH} SELECT src AS id, label, count(*) AS edges, count(DISTINCT dst) AS neighbours FROM graph JOIN nodes n ON n.id = graph.src AND n.kind = 'ORDER' WHERE label IN ('order_of_customer', 'order_has_part') GROUP BY ALL")
def neighbours_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, graph = graph_tables(spark, sf_dir)
    found = neighbours(known.filter("kind = 'ORDER'").select("id"), graph, ["order_of_customer", "order_has_part"], "out")
    return found.groupBy("id", "label").agg(F.count("*").alias("edges"), F.countDistinct("neighbour").alias("neighbours"))


@query(f"""WITH {GRAPH} SELECT DISTINCT a.dst AS id, a.src AS via, b.dst AS "end" FROM graph a JOIN graph b ON b.src = a.src AND b.label = 'supplier_of_nation'
           WHERE a.label = 'supplies_order' AND b.dst IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey > 0)""")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, its suppliers, and their nation if it is active (beyond the first region)."""
    graph = graph_tables(spark, sf_dir)[1]
    active = table(spark, sf_dir, "nation").filter("n_regionkey > 0").select(_key("n", "n_nationkey").alias("id"))
    return two_steps(graph, "supplies_order", "supplier_of_nation", active).distinct()


BEST = "ranked AS (SELECT o_orderkey, o_totalprice, o_orderdate, o_custkey, o_orderpriority, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_totalprice / max(o_totalprice) OVER () AS score FROM orders), results AS (SELECT * FROM ranked WHERE rank <= 15)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 best orders, with rank and score (price against the highest)."""
    orders = table(spark, sf_dir, "orders")
    most = orders.agg(F.max("o_totalprice").alias("most"))
    best = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)
    rank = F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey"))  # 15 rows
    return best.withColumn("rank", rank).join(F.broadcast(most)).withColumn("score", F.col("o_totalprice") / F.col("most")).drop("most")


@query(f"""WITH {GRAPH}, {BEST}, members AS (SELECT 'o' || o_orderkey AS id FROM results UNION SELECT 'c' || o_custkey FROM results
               UNION SELECT 's' || l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM results))
           SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_min(label, ordinal) AS label FROM graph WHERE src <> dst AND src IN (SELECT id FROM members) AND dst IN (SELECT id FROM members) GROUP BY 1, 2""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_tables(spark, sf_dir)[1]
    best = results(spark, sf_dir)
    suppliers = table(spark, sf_dir, "lineitem").join(F.broadcast(best), F.col("l_orderkey") == F.col("o_orderkey")).select(_key("s", "l_suppkey").alias("id"))
    members = best.select(F.explode(F.array(_key("o", "o_orderkey"), _key("c", "o_custkey"))).alias("id")).unionByName(suppliers)
    return induced(members, graph)


@query(f"""WITH {NODES}, planted AS (SELECT 'c' || c_custkey AS src, 'n' || (c_nationkey + CASE WHEN c_custkey % 97 = 0 THEN 20 ELSE 0 END) AS dst, 'customer_of_nation' AS label FROM customer
               UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplier_of_nation' FROM supplier)
           SELECT label, count(*) FILTER (dst NOT IN (SELECT id FROM nodes) OR src NOT IN (SELECT id FROM nodes)) AS dangling, count(*) AS edges FROM planted GROUP BY label""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared edges with an end that is unknown, by label; some customers' nations are made up."""
    known = graph_tables(spark, sf_dir)[0]
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nation = F.col("c_nationkey") + F.when(F.col("c_custkey") % 97 == 0, 20).otherwise(0)
    rows = [
        ForeignKey(customers.select(_key("c", "c_custkey").alias("id"), F.concat(F.lit("n"), nation.cast("string")).alias("to")), "id", "to", "customer_of_nation"),
        ForeignKey(suppliers.select(_key("s", "s_suppkey").alias("id"), _key("n", "s_nationkey").alias("to")), "id", "to", "supplier_of_nation"),
    ]
    keys = declared(rows, [])
    loose = dangling(keys, known).groupBy("label").agg(F.count("*").alias("dangling"))
    return keys.groupBy("label").agg(F.count("*").alias("edges")).join(loose, "label", "left").select("label", F.coalesce("dangling", F.lit(0)).alias("dangling"), "edges")


ROLE = "CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END"
CONTRIBUTIONS = f"""steps AS (SELECT l_orderkey AS id, l_suppkey AS neighbour, l_returnflag AS role, {ROLE} AS w, l_linenumber AS ordinal FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    picked AS (SELECT id, neighbour, arg_max({{'role': role, 'w': w}}, (w, ordinal)) AS best FROM steps GROUP BY ALL),
    contributed AS (SELECT p.id, p.neighbour, (best).role AS role, (best).w AS weight, 0.6::DOUBLE * s.score * (best).w AS contribution FROM picked p JOIN sources s USING (id))"""
ALL_SOURCES = "sources AS (SELECT o_orderkey AS id, o_totalprice / max(o_totalprice) OVER () AS score FROM orders)"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    most = orders.agg(F.max("o_totalprice").alias("most"))
    return orders.join(F.broadcast(most)).select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / F.col("most")).alias("score"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("neighbour"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("neighbour"), F.col("l_returnflag").alias("role"), F.col("l_linenumber").alias("ordinal"))
    return lines.join(suppliers, "neighbour", "left_semi")


@query(f"WITH {ALL_SOURCES}, {CONTRIBUTIONS} SELECT id, neighbour, role, weight, round(contribution, 6) AS contribution FROM contributed")
def propagate_parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contribution a pair, however many lines join it; the last line of the best role is the evidence."""
    found = contributions(_sources(spark, sf_dir), _steps(spark, sf_dir), ROLES)
    return found.withColumn("contribution", F.round("contribution", 6))


@query(f"WITH {ALL_SOURCES}, {CONTRIBUTIONS} SELECT neighbour, role, count(*) AS sources, round(sum(contribution), 4) AS total FROM contributed GROUP BY ALL")
def propagate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contributions(_sources(spark, sf_dir), _steps(spark, sf_dir), ROLES)
    return found.groupBy("neighbour", "role").agg(F.count("*").alias("sources"), F.round(F.sum("contribution"), 4).alias("total"))


TOP_SOURCES = f"{BEST}, sources AS (SELECT o_orderkey AS id, score FROM results)"
# Suppliers have the vectors of their numbers; the query's is the first.
LIKE = """alike AS (SELECT b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings))"""
SPREAD = f"""{TOP_SOURCES}, {CONTRIBUTIONS}, {LIKE},
    direct AS (SELECT neighbour, round(least(1.0::DOUBLE, sum(contribution)), 4) AS direct, count(*) AS sources FROM contributed GROUP BY 1),
    spread AS (SELECT d.neighbour, d.direct, round(0.4::DOUBLE * greatest(0.0::DOUBLE, coalesce(a.s, 0)), 4) AS affinity, d.sources FROM direct d LEFT JOIN alike a USING (neighbour))"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findara.operators.ranking import nearest

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    first = vectors.orderBy("id").limit(1).withColumnRenamed("id", "query")
    like = nearest(first, vectors).select(F.col("id").alias("neighbour"), "similarity")
    sources = results(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "score")
    return spread(contributions(sources, _steps(spark, sf_dir), ROLES), like)


@query(f"WITH {SPREAD} SELECT neighbour, direct, affinity, round(direct + affinity, 6) AS total, CASE WHEN direct + affinity >= 0.45 THEN 'Alta' WHEN direct + affinity >= 0.25 THEN 'Media' ELSE 'Baja' END AS band, CASE WHEN affinity > 0 THEN 'mixta' ELSE 'explicita' END AS nature, sources FROM spread")
def propagate_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).withColumn("total", F.round("total", 6))


@query(f"""WITH {BEST}, bridges AS (SELECT c_nationkey AS nation, greatest(0, max(score)) AS best FROM ranked JOIN customer ON c_custkey = o_custkey WHERE rank <= 15 GROUP BY 1),
           {LIKE}, j AS (SELECT s_suppkey, s_nationkey, best, greatest(coalesce(a.s, 0), 0) AS sem FROM supplier LEFT JOIN bridges ON nation = s_nationkey LEFT JOIN alike a ON a.neighbour = s_suppkey)
           SELECT s_suppkey, round(coalesce(best * 0.5::DOUBLE, 0), 4) AS bridge, round(0.4::DOUBLE * sem, 4) AS affinity, round(coalesce(best * 0.5::DOUBLE, 0) + 0.4::DOUBLE * sem, 4) AS total, CASE WHEN best IS NULL THEN 'inferida' ELSE 'mixta' END AS nature
           FROM j WHERE best IS NOT NULL OR sem >= 0.35""")
def bridge_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by the nation they share with the results' customers, or by likeness."""
    return _bridged(spark, sf_dir).select("s_suppkey", *[F.round(c, 4).alias(c) for c in ("bridge", "affinity", "total")], "nature")


def _bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findara.operators.ranking import nearest

    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("s_nationkey"))
    bridges = best_of(results(spark, sf_dir).join(customers, "o_custkey"), "s_nationkey", "score")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    like = nearest(vectors.orderBy("id").limit(1).withColumnRenamed("id", "query"), vectors).select(F.col("id").alias("s_suppkey"), "similarity")
    items = table(spark, sf_dir, "supplier").join(like, "s_suppkey", "left").withColumn("sem", F.coalesce("similarity", F.lit(0.0)))
    return bridged(items, bridges, "s_nationkey", F.col("sem"), F.lit(0.0))


@query(f"""WITH {LEXICAL}, {FACETS.replace("WITH", "")}, p AS (SELECT coalesce(l.query, o.query) AS query, coalesce(l.id, o.id) AS id, coalesce(l.similarity, 0) AS lex, coalesce(o.similarity, 0) AS dom
               FROM lexical l FULL JOIN (SELECT * FROM overlap WHERE facet = 'domain') o ON o.query = l.query AND o.id = l.id)
           SELECT query AS item_id, id AS doc_id, round(0.5::DOUBLE * lex, 4) AS affinity, round(0.3::DOUBLE * dom, 4) AS overlap, round(0.5::DOUBLE * lex + 0.3::DOUBLE * dom, 4) AS total FROM p WHERE round(0.5::DOUBLE * lex + 0.3::DOUBLE * dom, 9) >= 0.10""")
def capability_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_index(spark, sf_dir)
    lexical = index.similarities(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("similarity", "lex")
    domain = facet_overlaps(spark, sf_dir).filter("facet = 'domain'").select("query", "id", F.col("similarity").alias("dom"))
    zero = F.lit(0.0)
    pairs = lexical.join(domain, ["query", "id"], "full").select("query", "id", F.coalesce("lex", zero).alias("lex"), F.coalesce("dom", zero).alias("dom"))
    found = matched(pairs, zero, F.col("lex"), F.col("dom"))
    return found.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), *[F.round(c, 4).alias(c) for c in ("affinity", "overlap", "total")])


# Opportunities: orders are theses, suppliers people, nations units, programs and groups, parts capabilities.


def _theses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("year"), "score", "rank")


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, their suppliers by last line, and their nation if it is active."""
    nation = table(spark, sf_dir, "nation").filter("n_regionkey > 0")
    people = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_linenumber").alias("ordinal"))
    joined = lines.join(people, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("l_orderkey").cast("string").alias("id"), F.col("s_suppkey").cast("string").alias("via"), F.col("s_name").alias("via_name"), F.col("n_nationkey").cast("string").alias("end"), F.col("n_name").alias("end_name"), "ordinal")


def _ranked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir).orderBy(F.desc("total"), "neighbour").limit(10)
    rank = F.row_number().over(Window.orderBy(F.desc("total"), "neighbour"))  # ten rows
    named = people.withColumn("rank", rank).join(table(spark, sf_dir, "supplier"), F.col("neighbour") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("neighbour").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("unit"), F.col("total").alias("score"), "rank")


def _programs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation")
    sources = results(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sources = sources.select(F.col("n_nationkey").alias("program"), F.col("n_name").alias("program_name"), "score", "rank")
    best = _bridged(spark, sf_dir).orderBy(F.desc(F.round("total", 6)), "s_suppkey").limit(10)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("total", 6)), "s_suppkey"))  # ten rows
    return sources, best.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("program"), F.col("total").alias("score"), rank.alias("rank"))


def _capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    most = parts.agg(F.max("p_retailprice").alias("most"))
    best = parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(15).join(F.broadcast(most))
    rank = F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey"))  # 15 rows
    base = F.concat_ws("|", without_suffix(F.col("p_brand"), r"\s*#?\s*\d+\s*$"), "p_type")
    return best.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), base.alias("base"), F.col("p_size").alias("maturity"), (F.col("p_size") < 40).alias("active"), (F.col("p_retailprice") / F.col("most") / 2).alias("score"), rank.alias("rank"))


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").agg(F.coalesce(F.min(year), F.lit(2015)).alias("least"), F.coalesce(F.max(year), F.lit(2026)).alias("most"))




def _shown(df: DataFrame) -> DataFrame:
    return df.select("type", "title", F.array_join("related", ",").alias("related"), "reason", F.round("score", 6).alias("score"), "priority", "place")


def _priority_sql(c: str) -> str:
    return f"CASE WHEN {c} >= 0.45 THEN 'Alta' WHEN {c} >= 0.25 THEN 'Media' ELSE 'Baja' END"


CONTINUED = f"""{BEST}, directors AS (SELECT l_orderkey, l_suppkey, max(l_linenumber) AS ordinal FROM lineitem GROUP BY 1, 2),
    c AS (SELECT r.o_orderkey, r.o_orderpriority, r.score, r.rank, s.s_suppkey, s.s_name, n.n_nationkey, n.n_name, d.ordinal FROM results r JOIN directors d ON d.l_orderkey = r.o_orderkey
          JOIN supplier s ON s.s_suppkey = d.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_regionkey > 0 WHERE r.rank <= 3)"""


@query(f"""WITH {CONTINUED} SELECT 'RESEARCH_CONTINUITY' AS type, 'Continuidad investigativa a partir de ' || o_orderkey AS title, o_orderkey || ',' || s_suppkey || ',' || n_nationkey AS related,
           printf('%s es antecedente relevante (score %.2f). Su director, %s, pertenece al grupo activo %s, lo que habilita dar continuidad a esta línea.', o_orderpriority, score, s_name, n_name) AS reason,
           round(score, 6) AS score, {_priority_sql('score')} AS priority, CAST(row_number() OVER (ORDER BY rank, ordinal, CAST(s_suppkey AS VARCHAR)) AS INT) AS place FROM c""")
def opp_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(opp.continuity(_theses(spark, sf_dir), _directed(spark, sf_dir), F.lit("HIGH")))


@query(f"""WITH {SPREAD}, people AS (SELECT neighbour, direct + affinity AS total FROM spread ORDER BY direct + affinity DESC, neighbour LIMIT 10),
           p AS (SELECT neighbour, total, s_name, n_name, row_number() OVER (ORDER BY total DESC, neighbour) AS rank FROM people JOIN supplier ON s_suppkey = neighbour JOIN nation ON n_nationkey = s_nationkey),
           f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY rank) = 1),
           q AS (SELECT a.*, b.neighbour AS nb, b.total AS tb, b.s_name AS sb, b.n_name AS ub, b.rank AS rb FROM f a JOIN f b ON a.rank < b.rank ORDER BY a.rank, b.rank LIMIT 3)
           SELECT 'COLLABORATION' AS type, 'Colaboración interdisciplinaria: ' || n_name || ' + ' || ub AS title, neighbour || ',' || nb AS related,
           printf('%s (%s) y %s (%s) llegan a esta necesidad por evidencia independiente y pertenecen a facultades distintas: su combinación amplía el abordaje más allá de un solo dominio.', s_name, n_name, sb, ub) AS reason,
           round((total + tb) / 2, 6) AS score, {_priority_sql('(total + tb) / 2')} AS priority, CAST(row_number() OVER (ORDER BY rank, rb) AS INT) AS place FROM q""")
def opp_collaboration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(opp.collaboration(_ranked_people(spark, sf_dir), F.lit("HIGH")))


@query(f"""WITH {BEST}, bridges AS (SELECT c_nationkey AS nation, greatest(0, max(score)) AS best FROM results JOIN customer ON c_custkey = o_custkey GROUP BY 1), {LIKE},
           j AS (SELECT s_suppkey, s_name, s_nationkey, best, greatest(coalesce(a.s, 0), 0) AS sem FROM supplier LEFT JOIN bridges ON nation = s_nationkey LEFT JOIN alike a ON a.neighbour = s_suppkey),
           t AS (SELECT s_suppkey, s_name, s_nationkey AS program, coalesce(best * 0.5::DOUBLE, 0) + 0.4::DOUBLE * sem AS total FROM j WHERE best IS NOT NULL OR sem >= 0.35),
           ten AS (SELECT *, row_number() OVER (ORDER BY round(total, 6) DESC, s_suppkey) AS rank FROM t QUALIFY rank <= 10),
           covered AS (SELECT program, arg_max(s_suppkey, (total, -rank)) AS subject, arg_max(s_name, (total, -rank)) AS subject_name, greatest(0, max(total)) AS cover FROM ten GROUP BY 1),
           programs AS (SELECT n_nationkey AS program, n_name, max(score) AS source, min(rank) AS first FROM results JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
           g AS (SELECT p.*, subject, subject_name, coalesce(cover, 0) AS cover, coalesce(cover, 0) < 0.2 AS gap FROM programs p LEFT JOIN covered USING (program) WHERE coalesce(cover, 0) < 0.2 OR coalesce(cover, 0) >= 0.35)
           SELECT 'CURRICULAR_INTEGRATION' AS type, CASE WHEN gap THEN 'Brecha curricular en ' || n_name ELSE 'Integrar como caso de estudio en ' || subject_name END AS title,
           CASE WHEN gap THEN CAST(program AS VARCHAR) ELSE program || ',' || subject END AS related,
           CASE WHEN gap THEN printf('El programa %s produce antecedentes relevantes para esta necesidad, pero ninguna de sus asignaturas muestra articulación temática clara (mejor cobertura curricular encontrada: %.2f). Se sugiere revisar el currículo del programa.', n_name, cover)
           ELSE printf('La asignatura %s (%s) ya está alineada temáticamente (score %.2f); puede incorporar antecedentes reales del proyecto/tesis relacionado como caso de estudio.', subject_name, n_name, cover) END AS reason,
           round(CASE WHEN gap THEN source ELSE cover END, 6) AS score, {_priority_sql('CASE WHEN gap THEN source ELSE cover END')} AS priority, CAST(row_number() OVER (ORDER BY first, program) AS INT) AS place FROM g""")
def opp_curricular_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(opp.integration(*_programs(spark, sf_dir), F.lit("HIGH")))


@query(f"""WITH best AS (SELECT *, p_retailprice / (SELECT max(p_retailprice) FROM part) / 2 AS score, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 15),
           f AS (SELECT * FROM best WHERE p_size < 40 AND p_size >= 3 QUALIFY row_number() OVER (PARTITION BY regexp_replace(p_brand, '\\s*#?\\s*\\d+\\s*$', ''), p_type ORDER BY rank) = 1 ORDER BY rank LIMIT 3)
           SELECT 'CAPABILITY_ACTIVATION' AS type, 'Activar ' || p_name AS title, CAST(p_partkey AS VARCHAR) AS related,
           printf('%s tiene madurez %s/5, está activa y su perfil semántico se relaciona con la necesidad (score %.2f - inferido, sin arista explícita capacidad-proyecto en el dataset).', p_name, CAST(p_size AS VARCHAR), score) AS reason,
           round(score, 6) AS score, {_priority_sql('score')} AS priority, CAST(row_number() OVER (ORDER BY rank) AS INT) AS place FROM f""")
def opp_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(opp.activation(_capabilities(spark, sf_dir), F.lit("HIGH")))


#: Years that the query on old results takes off them, as the best order is a recent one.
EARLIER = 10


@query(f"""WITH {BEST}, y AS (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders)
           SELECT 'THESIS_OPPORTUNITY' AS type, 'Nuevo trabajo de grado que actualice ' || o_orderkey AS title, CAST(o_orderkey AS VARCHAR) AS related,
           printf('El antecedente más relevante disponible (%s) data de %d, anterior a la mitad del rango observado en el dataset (%d-%d). Es un hueco razonable para proponer un nuevo trabajo de grado que actualice esta línea.', o_orderpriority, year(o_orderdate) - {EARLIER}, a, b) AS reason,
           round(score, 6) AS score, {_priority_sql('score')} AS priority, 1 AS place FROM results, y WHERE rank = 1 AND year(o_orderdate) - {EARLIER} <= (a + b) / 2""")
def opp_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(opp.renewal(_older(spark, sf_dir), _years(spark, sf_dir), F.lit("HIGH")))


def _older(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _theses(spark, sf_dir).withColumn("year", F.col("year") - EARLIER)


def _all_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT {k} AS made, * FROM ({SQL[name]})" for k, name in enumerate(("opp_continuity", "opp_collaboration_pairs", "opp_curricular_gap", "opp_capability", "opp_stale")))
    order = "CASE priority WHEN 'Alta' THEN 0 WHEN 'Media' THEN 1 ELSE 2 END, made, place"
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INT) AS position, type, title, related, score, priority FROM ({parts})"


@query(_all_sql())
def opp_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five kinds for one search, by priority."""
    need = F.lit("HIGH")
    parts = [
        opp.continuity(_theses(spark, sf_dir), _directed(spark, sf_dir), need), opp.collaboration(_ranked_people(spark, sf_dir), need), opp.integration(*_programs(spark, sf_dir), need),
        opp.activation(_capabilities(spark, sf_dir), need), opp.renewal(_older(spark, sf_dir), _years(spark, sf_dir), need),
    ]
    return opp.combined(parts).select("position", "type", "title", F.array_join("related", ",").alias("related"), F.round("score", 6).alias("score"), "priority")


@query(f"""WITH {BEST} SELECT string_agg(printf('- %s (ORDER, id %d), confianza %s (score %.2f).', o_orderpriority, o_orderkey, CASE WHEN score >= 0.45 THEN 'Alta' WHEN score >= 0.25 THEN 'Media' ELSE 'Baja' END, score), chr(10) ORDER BY rank) AS context,
           string_agg(DISTINCT 'testdata / orders.parquet / ' || o_orderkey || ' / o_totalprice', ' | ' ORDER BY 'testdata / orders.parquet / ' || o_orderkey || ' / o_totalprice') AS citations FROM results WHERE rank <= 4""")
def assistant_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a narrator is told of the first four results, and their citations."""
    best = results(spark, sf_dir).filter("rank <= 4")
    line = F.format_string("- %s (ORDER, id %d), confianza %s (score %.2f).", "o_orderpriority", "o_orderkey", band(F.col("score")), "score")
    cited = F.concat_ws(" / ", F.lit("testdata"), F.lit("orders.parquet"), F.col("o_orderkey").cast("string"), F.lit("o_totalprice"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))  # four rows
    return best.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"), F.array_join(F.array_sort(F.collect_set(cited)), " | ").alias("citations"))
