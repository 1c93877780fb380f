"""Queries on values, texts and the lexical index."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findara.functions.evidence import citation, compared, provenance, top_fields, winner
from findara.functions.text import bigrams, digits, first_of, folded, joined, tokens, value, values, without_suffix
from findara.operators.lexical import LexicalIndex, term_counts, top
from findara.plans.catalog import FOLD, LEXICAL, TFIDF, TOKENS, query
from findara.session import shared_dir, table
from findara.sources.artifacts import fingerprint, get_or_build


def saved(spark: SparkSession, sf_dir: str, what: str, names: list[str], build, *parts: DataFrame) -> dict[str, DataFrame]:
    """Tables of an artefact in the shared folder, built again if one of the (id, text) tables it follows from changed."""
    digests = [fingerprint(p, *p.columns[:2]).first() for p in parts]
    manifest = {f"{n}{k}": str(d[n]) for k, d in enumerate(digests) for n in ("rows", "digest")} | {"format": "1"}
    folder = f"{shared_dir(spark)}/findara/{what}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return get_or_build(spark, folder, names, manifest, build)


def lexical_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The index of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def build() -> dict[str, DataFrame]:
        index = LexicalIndex.fit(docs, "doc_id", "text")
        return {"terms": index.terms, "weights": index.weights}

    return LexicalIndex(**saved(spark, sf_dir, "index", ["terms", "weights"], build, docs))


@query("""SELECT p_partkey, CAST(len(v) AS INT) AS n_values, v[1] AS first_value, array_to_string(v, '|') AS all_values
          FROM (SELECT p_partkey, [trim(x) for x in string_split(p_name, ' ') if trim(x) <> ''] AS v FROM part)""")
def multivalue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(F.col("p_name"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(v).alias("n_values"), F.get(v, F.lit(0)).alias("first_value"), F.array_join(v, "|").alias("all_values"))


@query(r"""SELECT o_orderkey, CASE WHEN regexp_full_match(split_part(o_orderpriority, '-', 1), '[0-9]+') THEN TRY_CAST(split_part(o_orderpriority, '-', 1) AS INT) END AS level,
           CASE WHEN regexp_full_match(o_orderpriority, '[0-9]+') THEN 1 ELSE 0 END AS whole_is_number FROM orders""")
def digit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.when(digits(F.col("o_orderpriority")).isNotNull(), 1).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", digits(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("level"), whole.alias("whole_is_number"))


@query(r"""SELECT base, p_type, count(*) AS n, min(p_partkey) AS first_part
           FROM (SELECT regexp_replace(p_brand, '\s*#?\s*\d+\s*$', '') AS base, p_type, p_partkey FROM part) GROUP BY ALL""")
def base_name_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = without_suffix(F.col("p_brand"), r"\s*#?\s*\d+\s*$")
    return table(spark, sf_dir, "part").groupBy(base.alias("base"), "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("""SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), ''), nullif(trim(c_name), ''), CAST(c_custkey AS VARCHAR)) AS display_name FROM customer""")
def display_name_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", first_of([F.col("c_mktsegment"), F.col("c_name")], F.col("c_custkey")).alias("display_name"))


@query("""SELECT p_partkey, array_to_string([x for x in [trim(coalesce(p_name, '')), trim(coalesce(p_brand, '')), trim(coalesce(p_type, ''))] if x <> ''], ' . ') AS indexable FROM part""")
def indexable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [value(F.col(c)) for c in ("p_name", "p_brand", "p_type")]
    return table(spark, sf_dir, "part").select("p_partkey", joined(fields).alias("indexable"))


@query(f"""SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct, list_min(t) AS first_term
           FROM (SELECT doc_id, {TOKENS.format(c=FOLD.format(c="text"))} AS t FROM documents)""")
def accent_fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens(folded(F.col("text"))).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.array_min("t").alias("first_term"))


@query(f"SELECT doc_id, CAST(len({TOKENS.format(c='text')}) AS INT) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"))


@query(f"""WITH t AS (SELECT {TOKENS.format(c='text')} AS toks FROM documents),
           b AS (SELECT unnest([toks[i] || ' ' || toks[i + 1] for i in range(1, len(toks))]) AS bigram FROM t)
           SELECT bigram, count(*) AS n FROM b GROUP BY bigram ORDER BY n DESC, bigram LIMIT 100""")
def ngram_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select(F.explode(bigrams(tokens(F.col("text")))).alias("bigram"))
    return pairs.groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(100)


@query(f"WITH {TFIDF} SELECT term, df, round(idf, 6) AS idf FROM terms")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_index(spark, sf_dir)
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {TFIDF}, r AS (SELECT id AS doc_id, term, round(w, 6) AS w FROM dw)
           SELECT doc_id, term, w, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank FROM r) WHERE rank <= 5""")
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_index(spark, sf_dir)
    rows = index.weights.select(F.col("id").alias("doc_id"), "term", F.round("w", 6).alias("w"))
    return top(rows, 5, "w", ["doc_id"], ["term"])


@query(f"""WITH {TFIDF} SELECT id AS doc_id, count(*) AS n_terms, round(sqrt(sum(w * w)), 6) AS norm, round(max(w), 6) AS largest FROM dw GROUP BY id""")
def tfidf_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_index(spark, sf_dir)
    w = F.col("w")
    return index.weights.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_terms"), F.round(F.sqrt(F.sum(w * w)), 6).alias("norm"), F.round(F.max(w), 6).alias("largest"))


def _lexical(spark: SparkSession, sf_dir: str, queries: DataFrame) -> DataFrame:
    index = lexical_index(spark, sf_dir)
    found = index.similarities(queries, "item_id", "text").select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), F.round("similarity", 6).alias("score"))
    return top(found, 10, "score", ["item_id"], ["doc_id"])


@query(f"""WITH {LEXICAL}, r AS (SELECT query AS item_id, id AS doc_id, round(similarity, 6) AS score FROM lexical WHERE query = (SELECT min(item_id) FROM benchmark))
           SELECT item_id, doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM r ORDER BY score DESC, doc_id LIMIT 10""")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text, the first benchmark item, against all documents."""
    one = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1)
    return _lexical(spark, sf_dir, one)


@query(f"""WITH {LEXICAL}, r AS (SELECT query AS item_id, id AS doc_id, round(similarity, 6) AS score FROM lexical)
           SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def lexical_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, table(spark, sf_dir, "benchmark"))


@query("""SELECT p_partkey, 'testdata / part.parquet / ' || p_partkey || ' / p_name' AS citation FROM part""")
def provenance_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = provenance("catalogue", "part.parquet", F.col("p_partkey"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", citation(p, "testdata").alias("citation"))


@query("""WITH f AS (SELECT doc_id, [x for x in [{'n': 'lang', 't': trim(coalesce(lang, ''))}, {'n': 'source', 't': trim(coalesce(source, ''))}, {'n': 'n_chars', 't': coalesce(CAST(n_chars AS VARCHAR), '')},
                     {'n': 'text', 't': trim(coalesce(text, ''))}] if x.t <> ''][1:3] AS e FROM documents)
          SELECT doc_id, array_to_string([x.n || '=' || x.t for x in e], '; ') AS evidence, CAST(len(e) AS INT) AS n FROM f""")
def evidence_top_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {c: value(F.col(c)) for c in ("lang", "source", "n_chars", "text")}
    e = top_fields("corpus", "documents.parquet", F.col("doc_id"), fields)
    told = F.array_join(F.transform(e, lambda x: F.concat(x["provenance"]["field"], F.lit("="), x["text"])), "; ")
    return table(spark, sf_dir, "documents").select("doc_id", told.alias("evidence"), F.size(e).alias("n"))


@query("""WITH s AS (SELECT o_orderpriority AS k, sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS share, avg(o_totalprice) AS mean FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
               t AS (SELECT o_orderpriority AS k, sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS share FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
          SELECT coalesce(s.k, t.k) AS component, round(coalesce(s.share, 0) - coalesce(t.share, 0), 6) AS difference,
                 CASE WHEN (SELECT max(share) FROM t) > (SELECT max(share) FROM s) THEN 'B' ELSE 'A' END AS winner FROM s FULL JOIN t ON s.k = t.k""")
def compare_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two breakdowns, of finished and open orders by priority, component by component."""
    sums = table(spark, sf_dir, "orders").filter("o_orderstatus in ('F', 'O')").groupBy("o_orderstatus", "o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    part = F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "s")))  # an entry a priority
    maps = sums.groupBy("o_orderstatus").agg(part.alias("m"), F.sum("s").alias("all"))
    shares = F.transform_values("m", lambda k, v: v / F.col("all"))
    one = maps.groupBy().agg(F.max(F.when(F.col("o_orderstatus") == "F", F.to_json(shares))).alias("a"), F.max(F.when(F.col("o_orderstatus") == "O", F.to_json(shares))).alias("b"))
    a, b = (F.coalesce(F.from_json(c, "map<string,double>"), F.create_map().cast("map<string,double>")) for c in "ab")
    best = lambda m: F.array_max(F.map_values(m))
    return one.select(F.explode(compared(a, b)).alias("component", "d"), winner(best(a), best(b)).alias("winner")).select("component", F.round("d", 6).alias("difference"), "winner")


def _hash_sql() -> str:
    row = "sha256(CAST(doc_id AS VARCHAR) || chr(0) || coalesce(text, '') || chr(0))"
    sums = ", ".join(f"CAST(sum(CAST(('0x' || substring({row}, {1 + 15 * k}, 15)) AS BIGINT)) AS VARCHAR) AS s{k}" for k in range(4))
    return f"WITH s AS (SELECT count(*) AS rows, {sums} FROM documents) SELECT rows, sha256(concat_ws('|', rows, s0, s1, s2, s3)) AS digest FROM s"


@query(_hash_sql())
def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest that decides whether saved artefacts are still valid."""
    return fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text")
