"""Queries on facets, evidence, vectors, hybrid scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findara.functions.evidence import citation, cited, explanation, factors, nature_sentence, opening, provenance, shared_terms
from findara.functions.scores import RELIABILITY, VARIANTS, WEIGHTS, band, completeness, effective, looked_up, recency
from findara.functions.text import bigrams, folded, tokens, value
from findara.operators import facets
from findara.operators.candidates import candidates, plain
from findara.operators.evaluation import mean, metrics, silver
from findara.operators.lexical import top
from findara.operators.propagation import mode
from findara.operators.ranking import hybrid, mmr, nearest
from findara.operators.signals import signals as all_signals
from findara.plans.catalog import EVIDENCE, FACETS, SIGNALS, VOCABULARY, flow_band, hybrid_sql, query
from findara.plans.text_queries import lexical_index, saved
from findara.session import table, written

FACETS_OF = ("topic", "domain", "method")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics are benchmark bigrams of one item, methods those of several, domains its long tokens."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return saved(spark, sf_dir, "vocabulary", ["vocabulary"], lambda: {"vocabulary": _vocabulary(items)}, items)["vocabulary"]


def _vocabulary(items: DataFrame) -> DataFrame:
    words = items.select("item_id", tokens(folded(F.col("text"))).alias("toks"))
    pairs = words.select("item_id", F.explode(bigrams(F.col("toks"))).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("items"))
    single = words.select(F.explode("toks").alias("term")).distinct()
    return facets.vocabulary([("topic", pairs.filter("items = 1")), ("method", pairs.filter("items > 1")), ("domain", single.filter(F.length("term") >= 10))])


def document_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocab = table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(spark, sf_dir)
    build = lambda: {"facets": facets.extract(docs, vocab, "doc_id", "text")}
    return saved(spark, sf_dir, "facets", ["facets"], build, docs, vocab)["facets"]


def facet_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = facets.extract(table(spark, sf_dir, "benchmark"), vocabulary(spark, sf_dir), "item_id", "text")
    return facets.overlaps(asked, document_facets(spark, sf_dir))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    votes = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("level", F.when(F.col("quality") == 1, "HIGH").when(F.col("quality") == 0, "LOW"))
    return mode(votes, "source", "level", "doc_id")


def _complete(docs: DataFrame) -> DataFrame:
    """``id, s, complete, size``: source, share of fields that documents have, bytes of text."""
    full = completeness([value(F.col(c)) for c in ("text", "lang", "source")])
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("s"), full.alias("complete"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))


def strength(spark: SparkSession, sf_dir: str, complete: DataFrame | None = None) -> DataFrame:
    """``id, evidence``: completeness times the reliability of the source; documents have no year."""
    rows = (_complete(table(spark, sf_dir, "documents")) if complete is None else complete).drop("size")
    levels = reliability(spark, sf_dir)
    joined = rows.join(levels, rows["s"].eqNullSafe(levels["source"]), "left")
    weight = looked_up(F.coalesce("level", F.lit("NO_CATALOGADO")), RELIABILITY, 0.6)
    return joined.select("id", (F.col("complete") * weight).alias("evidence"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query, id, semantic, lexical, topic, domain, method, evidence`` of every benchmark item and document."""
    items = table(spark, sf_dir, "benchmark")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    # Items and documents pair with the vectors of their numbers.
    asked = items.select(F.col("item_id").alias("query")).join(vectors.toDF("query", "asked_vector"), "query", "left")
    corpus = strength(spark, sf_dir).join(vectors, "id", "left")
    index = lexical_index(spark, sf_dir)
    asked_found = facets.extract(items, vocabulary(spark, sf_dir), "item_id", "text")
    out = all_signals(corpus, asked, index.weights, index.asked(items, "item_id", "text"), document_facets(spark, sf_dir), asked_found)
    return out.select("query", "id", "semantic", "lexical", *FACETS_OF, "evidence")


@query(f"WITH {VOCABULARY} SELECT facet, term FROM vocab")
def vocabulary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir)


@query(f"WITH {FACETS} SELECT id AS doc_id, facet, count(*) AS n_terms, min(term) AS first_term FROM df GROUP BY ALL")
def facet_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_facets(spark, sf_dir).groupBy(F.col("id").alias("doc_id"), "facet").agg(F.count("*").alias("n_terms"), F.min("term").alias("first_term"))


@query(f"WITH {FACETS} SELECT query AS item_id, id AS doc_id, facet, round(similarity, 6) AS jaccard FROM overlap")
def facet_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_overlaps(spark, sf_dir).select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "facet", F.round("similarity", 6).alias("jaccard"))


@query(f"WITH {FACETS} SELECT query AS item_id, id AS doc_id, facet, shared, terms FROM overlap")
def facet_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_overlaps(spark, sf_dir).select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "facet", "shared", F.array_join("terms", ", ").alias("terms"))


@query(f"WITH {EVIDENCE} SELECT source, level FROM reliability")
def reliability_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability(spark, sf_dir)


@query("SELECT o_orderstatus, CAST(coalesce(min(year(o_orderdate)), 2015) AS INT) AS first_year, CAST(coalesce(max(year(o_orderdate)), 2026) AS INT) AS last_year FROM orders GROUP BY 1")
def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.coalesce(F.min(year), F.lit(2015)).alias("first_year"), F.coalesce(F.max(year), F.lit(2026)).alias("last_year"))


@query("""WITH r AS (SELECT o_orderstatus, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders GROUP BY 1)
          SELECT o_orderkey, round(CASE WHEN o_orderdate IS NULL THEN 0.8::DOUBLE ELSE 0.6::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (year(o_orderdate) - a) / greatest(1, b - a))) END, 6) AS recency
          FROM orders JOIN r USING (o_orderstatus)""")
def recency_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ranges = year_range(spark, sf_dir)
    joined = orders.join(ranges, "o_orderstatus")
    return joined.select("o_orderkey", F.round(recency(F.year("o_orderdate"), F.col("first_year"), F.col("last_year")), 6).alias("recency"))


@query("""SELECT doc_id, round(((trim(coalesce(d.text, '')) <> '')::INT + (trim(coalesce(d.lang, '')) <> '')::INT + (trim(coalesce(d.source, '')) <> '')::INT + (l.quality IS NOT NULL)::INT) / 4.0::DOUBLE, 6) AS completeness
          FROM documents d LEFT JOIN labels l USING (doc_id)""")
def completeness_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.round(completeness([value(F.col(c)) for c in ("text", "lang", "source", "quality")]), 6).alias("completeness"))


@query(f"WITH {EVIDENCE} SELECT id AS doc_id, round(evidence, 6) AS evidence FROM strength")
def evidence_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strength(spark, sf_dir).select(F.col("id").alias("doc_id"), F.round("evidence", 6).alias("evidence"))


KNN = """k AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE {asked})"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, sf_dir: str, one: bool) -> DataFrame:
    """The stated queries: the first vector, or every row whose id is divisible by 50."""
    rows = _vectors(spark, sf_dir).withColumnRenamed("id", "query")
    return rows.orderBy("query").limit(1) if one else rows.filter(F.col("query") % 50 == 0)


def _nearest(spark: SparkSession, sf_dir: str, one: bool) -> DataFrame:
    found = nearest(_asked(spark, sf_dir, one), _vectors(spark, sf_dir))
    return found.select("query", "id", F.round("similarity", 6).alias("score"))


@query(f"WITH {KNN.format(asked='a.vec_id = (SELECT min(vec_id) FROM embeddings)')} SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM k ORDER BY score DESC, id LIMIT 20")
def cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(_nearest(spark, sf_dir, True), 20, "score", ["query"], ["id"]).drop("query")


@query(f"WITH {KNN.format(asked='a.vec_id % 50 = 0')} SELECT query, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM k) WHERE rank <= 10")
def cosine_knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(_nearest(spark, sf_dir, False), 10, "score", ["query"], ["id"])


HYBRID_TOP = """r AS (SELECT query AS item_id, id AS doc_id, round({score}, 6) AS score, {more} FROM scored)
    SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM r QUALIFY rank <= 10"""


@query(f"WITH {SIGNALS}, {hybrid_sql()}, {HYBRID_TOP.format(score='raw', more='lone')}")
def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best before the penalty, and whether it applies."""
    scored = hybrid(signals(spark, sf_dir), WEIGHTS)
    rows = scored.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), F.round(F.col("total") - F.col("penalty"), 6).alias("score"), (F.col("penalty") != 0).alias("lone"))
    rows = rows.withColumn("lone", F.coalesce("lone", F.lit(False)))
    return top(rows, 10, "score", ["item_id"], ["doc_id"])


RELATION = "CASE WHEN lone THEN 'metodo_transferible' ELSE 'antecedente_relevante' END AS relation"


@query(f"WITH {SIGNALS}, {hybrid_sql()}, {HYBRID_TOP.format(score='total', more=RELATION + ', ' + flow_band('total') + ' AS band')}")
def hybrid_score_penalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hybrid(signals(spark, sf_dir), WEIGHTS)
    rows = scored.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), F.round("total", 6).alias("score"), "relation", "band")
    return top(rows, 10, "score", ["item_id"], ["doc_id"])


@query(f"WITH {SIGNALS}, {hybrid_sql(semantic=0.0, lexical=0.5)}, {HYBRID_TOP.format(score='total', more=RELATION)}")
def hybrid_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without semantic vectors the lexical score has their weight."""
    scored = hybrid(signals(spark, sf_dir), WEIGHTS, semantic=False)
    rows = scored.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), F.round("total", 6).alias("score"), "relation")
    return top(rows, 10, "score", ["item_id"], ["doc_id"])


@query(f"WITH {SIGNALS}, {hybrid_sql()} SELECT {flow_band('round(total, 6)')} AS band, count(*) AS pairs, count(DISTINCT id) AS documents FROM scored GROUP BY 1")
def band_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hybrid(signals(spark, sf_dir), WEIGHTS)
    return scored.groupBy(band(F.round("total", 6)).alias("band")).agg(F.count("*").alias("pairs"), F.countDistinct("id").alias("documents"))


def _variant_sql() -> str:
    parts = []
    for name, (weights, _) in VARIANTS.items():
        w = effective(weights, True)
        raw = " + ".join(f"{v}::DOUBLE * {k}" for k, v in w.items())
        parts.append(f"SELECT '{name}' AS variant, query, id, round(CASE WHEN topic = 0 AND method > 0 THEN ({raw}) * 0.5::DOUBLE ELSE {raw} END, 6) AS score FROM signals")
    return "swept AS (" + " UNION ALL ".join(parts) + ")"


def _variant_score(weights: dict[str, float]) -> Column:
    lone = (F.col("topic") == 0) & (F.col("method") > 0)
    raw = sum((F.lit(float(w)) * F.col(k) for k, w in effective(weights, True).items()), F.lit(0.0))
    return F.round(F.when(lone, raw * 0.5).otherwise(raw), 6)


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``variant, query, id, score``: every variant's weights on the same signals, which are read once."""
    every = signals(spark, sf_dir)
    scores = [F.struct(F.lit(name).alias("variant"), _variant_score(weights).alias("score")) for name, (weights, _) in VARIANTS.items()]
    return every.select("query", "id", F.explode(F.array(*scores)).alias("s")).select("s.variant", "query", "id", "s.score")


@query(f"WITH {SIGNALS}, {_variant_sql()} SELECT variant, query AS item_id, id AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY variant, query ORDER BY score DESC, id) AS rank FROM swept) WHERE rank = 1")
def weights_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top(_swept(spark, sf_dir), 1, "score", ["variant", "query"], ["id"])
    return best.select("variant", F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "score")


def _pool(spark: SparkSession, sf_dir: str, one: bool) -> DataFrame:
    found = _nearest(spark, sf_dir, one)
    return top(found, 50, "score", ["query"], ["id"]).drop("rank").join(_vectors(spark, sf_dir), "id")


def mmr_sql(asked: str, k: int, weight: float) -> str:
    """Greedy choice as a recursion over the chosen ids of each query."""
    return f"""WITH RECURSIVE {KNN.format(asked=asked)},
        pool AS (SELECT query, id, score, vector, max(score) OVER (PARTITION BY query) AS most FROM (
            SELECT k.query, k.id, k.score, e.embedding::DOUBLE[] AS vector, row_number() OVER (PARTITION BY k.query ORDER BY score DESC, id) AS place FROM k JOIN embeddings e ON e.vec_id = k.id) WHERE place <= 50),
        alike AS (SELECT a.query, a.id AS a, b.id AS b, list_cosine_similarity(a.vector, b.vector) AS s FROM pool a JOIN pool b USING (query)),
        steps AS (
            SELECT query, 0 AS rank, CAST([] AS BIGINT[]) AS chosen, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS mmr FROM (SELECT DISTINCT query FROM pool)
            UNION ALL
            SELECT query, rank + 1, list_append(chosen, (best).id), (best).id, (best).mmr FROM (
                SELECT s.query, s.rank, s.chosen, arg_max({{'id': p.id, 'mmr': m.mmr}}, (m.mmr, p.score, -p.id)) AS best
                FROM steps s JOIN pool p ON p.query = s.query AND NOT list_contains(s.chosen, p.id),
                LATERAL (SELECT round({weight}::DOUBLE * (p.score / p.most) - {round(1 - weight, 6)}::DOUBLE * coalesce((SELECT max(x.s) FROM alike x WHERE x.query = p.query AND x.a = p.id AND list_contains(s.chosen, x.b)), 0), 9) AS mmr) m
                WHERE s.rank < {k} GROUP BY s.query, s.rank, s.chosen))
        SELECT query, id, CAST(rank AS INT) AS rank, round(mmr, 6) AS mmr FROM steps WHERE rank > 0"""


@query(mmr_sql("a.vec_id = (SELECT min(vec_id) FROM embeddings)", 10, 0.7))
def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mmr(_pool(spark, sf_dir, True)).select("query", "id", "rank", F.round("mmr", 6).alias("mmr"))


@query(f"WITH {KNN.format(asked='a.vec_id = (SELECT min(vec_id) FROM embeddings)')} SELECT query, id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank, round(score / max(score) OVER (), 6) AS mmr FROM k ORDER BY score DESC, id LIMIT 10")
def mmr_lambda_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mmr(_pool(spark, sf_dir, True), weight=1.0).select("query", "id", "rank", F.round("mmr", 6).alias("mmr"))


@query(mmr_sql("a.vec_id % 50 = 0", 5, 0.7))
def mmr_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mmr(_pool(spark, sf_dir, False), k=5).select("query", "id", "rank", F.round("mmr", 6).alias("mmr"))


SILVER = f"""{FACETS}, relevant AS (SELECT query, id FROM fshare WHERE facet = 'topic' AND shared >= 2)"""


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an item and a document that share two topics."""
    asked = facets.extract(table(spark, sf_dir, "benchmark"), vocabulary(spark, sf_dir), "item_id", "text")
    topics = lambda df: df.filter("facet = 'topic'").select("id", "term")
    return silver(topics(asked), topics(document_facets(spark, sf_dir)))


@query(f"WITH {SILVER} SELECT query AS item_id, id AS doc_id FROM relevant")
def silver_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevant(spark, sf_dir).select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"))


METRICS = """marked AS (SELECT r.query, r.rank FROM ranking r JOIN relevant v USING (query, id)),
    found AS (SELECT query, count(*) FILTER (rank <= 10) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg, min(rank) AS first FROM marked GROUP BY query),
    sizes AS (SELECT query, count(*) AS n, list_sum([1 / log2(i + 1) for i in range(1, least(count(*), 10) + 1)]) AS ideal FROM relevant GROUP BY query),
    measured AS (SELECT s.query, coalesce(hits, 0) / 10.0::DOUBLE AS precision, coalesce(hits / n, 0) AS recall, coalesce(dcg / ideal, 0) AS ndcg, coalesce(1 / first, 0) AS mrr FROM sizes s LEFT JOIN found f USING (query))"""

RANKING = "ranking AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(total, 6) DESC, id) AS rank FROM scored QUALIFY rank <= 50)"


@query(f"WITH {SIGNALS}, relevant AS (SELECT query, id FROM fshare WHERE facet = 'topic' AND shared >= 2), {hybrid_sql()}, {RANKING}, {METRICS} SELECT query AS item_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM measured")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hybrid(signals(spark, sf_dir), WEIGHTS).select("query", "id", F.round("total", 6).alias("score"))
    out = metrics(top(scored, 50, "score", ["query"], ["id"]), _relevant(spark, sf_dir), 10)
    return out.select(F.col("query").alias("item_id"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "mrr")])


def _ablation_sql() -> str:
    ranking = "ranking0 AS (SELECT variant, query, id, row_number() OVER (PARTITION BY variant, query ORDER BY score DESC, id) AS rank FROM swept QUALIFY rank <= 10)"
    return f"""WITH {SIGNALS}, relevant AS (SELECT query, id FROM fshare WHERE facet = 'topic' AND shared >= 2), {_variant_sql()}, {ranking},
        found AS (SELECT variant, query, sum(1 / log2(rank + 1)) AS dcg FROM ranking0 JOIN relevant USING (query, id) GROUP BY ALL),
        sizes AS (SELECT query, list_sum([1 / log2(i + 1) for i in range(1, least(count(*), 10) + 1)]) AS ideal FROM relevant GROUP BY query)
        SELECT variant, round(avg(coalesce(dcg / ideal, 0)), 4) AS ndcg, count(*) AS items FROM (SELECT DISTINCT variant FROM swept) CROSS JOIN sizes LEFT JOIN found USING (variant, query) GROUP BY variant"""


@query(_ablation_sql())
def ablation_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean NDCG of each variant's weights, ranked by score."""
    ranked = top(_swept(spark, sf_dir), 10, "score", ["variant", "query"], ["id"])
    names = spark.createDataFrame([(n,) for n in VARIANTS], "variant string")
    pair = lambda df: df.withColumn("query", F.struct("variant", "query"))
    relevant = _relevant(spark, sf_dir).join(F.broadcast(names))
    measured = metrics(pair(ranked).select("query", "id", "rank"), pair(relevant).select("query", "id"), 10)
    return measured.groupBy(F.col("query.variant").alias("variant")).agg(F.round(mean(F.col("ndcg")), 4).alias("ndcg"), F.count("*").alias("items"))


def _variant_pools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``variant, query, id, score``, each variant's best 50 documents or more, and the relevant pairs ``query, id``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items, vocab, vectors = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), vocabulary(spark, sf_dir), _vectors(spark, sf_dir)
    complete = written(_complete(table(spark, sf_dir, "documents")), "complete")  # texts are long and read once here
    size = plain(complete, items, vectors, vocab)
    if size is None:  # repeated or missing identifiers, odd vectors or terms
        return _swept(spark, sf_dir), _relevant(spark, sf_dir)
    asked = items.join(vectors.withColumnRenamed("id", "query"), "query", "left")
    corpus = strength(spark, sf_dir, complete).join(vectors, "id", "left")
    found = candidates(docs, corpus, asked, vocab, [w for w, _ in VARIANTS.values()], 50, 2, size)
    scores = F.array(*[_variant_score(weights) for weights, _ in VARIANTS.values()])
    names = F.array(*[F.lit(n) for n in VARIANTS])
    best = found.filter("variant >= 0").select(F.get(names, F.col("variant")).alias("variant"), "query", "id", F.get(scores, F.col("variant")).alias("score"))
    return best, found.filter("variant < 0").select("query", "id")


@query(None)
def ablation_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablation with each variant's own diversity weight, from a pool of 50."""
    pools, relevant = _variant_pools(spark, sf_dir)
    swept = top(pools, 50, "score", ["variant", "query"], ["id"]).withColumn("query", F.struct("variant", "query"))
    pool = swept.select("query", "id", "score").join(_vectors(spark, sf_dir), "id", "left")
    weight = looked_up(F.col("query.variant"), {n: lam for n, (_, lam) in VARIANTS.items()}, 0.7)
    ranked = mmr(pool, weight=weight)
    names = spark.createDataFrame([(n,) for n in VARIANTS], "variant string")
    relevant = relevant.join(F.broadcast(names)).withColumn("query", F.struct("variant", "query")).select("query", "id")
    measured = metrics(ranked.select("query", "id", "rank"), relevant, 10)
    return measured.groupBy(F.col("query.variant").alias("variant")).agg(F.round(mean(F.col("ndcg")), 4).alias("ndcg"), F.count("*").alias("items"))


@query(f"""WITH {EVIDENCE} SELECT d.lang, round(avg((s.evidence > 0)::INT), 6) AS evidence_coverage, round(avg((r.source IS NOT NULL)::INT), 6) AS traceability, count(*) AS n
           FROM documents d JOIN strength s ON s.id = d.doc_id LEFT JOIN reliability r ON r.source = d.source GROUP BY 1""")
def coverage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = docs.join(strength(spark, sf_dir).withColumnRenamed("id", "doc_id"), "doc_id").join(reliability(spark, sf_dir), "source", "left")
    share = lambda c: F.round(mean(c.cast("int")), 6)
    return rows.groupBy("lang").agg(share(F.col("evidence") > 0).alias("evidence_coverage"), share(F.col("level").isNotNull()).alias("traceability"), F.count("*").alias("n"))


@query("""SELECT event_type, s[least(len(s) - 1, CAST(floor(len(s) * 0.5) AS BIGINT)) + 1] AS p50, s[least(len(s) - 1, CAST(floor(len(s) * 0.95) AS BIGINT)) + 1] AS p95
          FROM (SELECT event_type, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY 1)""")
def latency_percentile_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at a nearest index, not interpolated, by counting: no group is gathered."""
    events = table(spark, sf_dir, "events").filter("value is not null").select("event_type", "value")
    counts = events.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    upto = Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("end", F.sum("n").over(upto)).join(events.groupBy("event_type").agg(F.count("*").alias("all")), "event_type")
    at = lambda share: F.min(F.when(F.col("end") > F.least(F.col("all") - 1, F.floor(F.col("all") * F.lit(share))), F.col("value")))
    return placed.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query(None)
def explanation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence for each item's three best documents."""
    scored = hybrid(signals(spark, sf_dir), WEIGHTS).withColumn("score", F.round("total", 6))
    best = top(scored, 3, "score", ["query"], ["id"])
    shared = facet_overlaps(spark, sf_dir).groupBy("query", "id").agg(*[F.max(F.when(F.col("facet") == f, F.col("terms"))).alias(f"t_{f}") for f in FACETS_OF])
    rows = best.join(shared, ["query", "id"], "left").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    names = {"semantic": "semantico", "lexical": "lexico", "topic": "tema", "domain": "dominio", "method": "metodo", "evidence": "evidencia"}
    parts = F.create_map(*[x for k, v in names.items() for x in (F.lit(v), F.col(f"c_{k}"))])
    source = citation(provenance("corpus", "documents.parquet", F.col("id"), "text"), "testdata")
    told = explanation(
        opening(F.col("relation"), F.col("source"), F.lit("PROJECT"), F.col("id").cast("string"), F.col("total"), F.col("band")),
        shared_terms({f: F.col(f"t_{f}") for f in FACETS_OF}), factors(parts, F.col("penalty") != 0), nature_sentence(F.lit("inferida"), "testdata"), cited(F.array(source)),
    )
    return rows.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "rank", told.alias("explanation"))
