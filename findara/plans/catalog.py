"""Registered queries: a callable (spark, sf_dir) -> DataFrame and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` None: tested against brute force instead."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Pieces of SQL that several queries share.
TOKENS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def grams_sql(name: str, source: str, key: str, column: str = "text") -> str:
    """CTEs ``name``_t (id, toks) and ``name`` (id, term), tokens and bigrams with repeats."""
    return f"""{name}_t AS (SELECT {key} AS id, {TOKENS.format(c=column)} AS toks FROM {source}),
    {name} AS (SELECT id, unnest(list_concat(toks, [toks[i] || ' ' || toks[i + 1] for i in range(1, len(toks))])) AS term FROM {name}_t)"""


TFIDF = f"""{grams_sql("dg", "documents", "doc_id")},
    dtf AS (SELECT id, term, count(*) AS tf FROM dg GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM documents),
    terms AS (SELECT term, count(*) AS df, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM dtf, n GROUP BY term),
    draw AS (SELECT id, term, (1 + ln(tf)) * idf AS raw FROM dtf JOIN terms USING (term)),
    dnorm AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM draw GROUP BY id),
    dw AS (SELECT id, term, raw / norm AS w FROM draw JOIN dnorm USING (id))"""

LEXICAL = f"""{TFIDF},
    {grams_sql("qg", "benchmark", "item_id")},
    qtf AS (SELECT id, term, count(*) AS tf FROM qg GROUP BY ALL),
    qraw AS (SELECT id, term, (1 + ln(tf)) * idf AS raw FROM qtf JOIN terms USING (term)),
    qnorm AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM qraw GROUP BY id),
    qw AS (SELECT id AS query, term, raw / norm AS q FROM qraw JOIN qnorm USING (id)),
    lexical AS (SELECT query, id, sum(q * w) AS similarity FROM qw JOIN dw USING (term) GROUP BY ALL)"""

FOLD = "strip_accents(lower(trim({c})))"

VOCABULARY = f"""bt AS (SELECT item_id, {TOKENS.format(c=FOLD.format(c="text"))} AS toks FROM benchmark),
    bb AS (SELECT DISTINCT item_id, unnest([toks[i] || ' ' || toks[i + 1] for i in range(1, len(toks))]) AS term FROM bt),
    bc AS (SELECT term, count(*) AS items FROM bb GROUP BY term),
    bu AS (SELECT DISTINCT unnest(toks) AS term FROM bt),
    vocab AS (SELECT 'topic' AS facet, term FROM bc WHERE items = 1
              UNION ALL SELECT 'method', term FROM bc WHERE items > 1
              UNION ALL SELECT 'domain', term FROM bu WHERE length(term) >= 10)"""

# A whole word: no word character on either side.  Terms are one or two tokens, so a text that has one has it among
# its tokens and bigrams; it is then looked for as it stands.
HAS = r"regexp_matches(t.text, '(^|[^\p{L}\p{N}_])' || v.term || '($|[^\p{L}\p{N}_])')"


def facet_sql(name: str, source: str, key: str) -> str:
    """CTEs of the facets ``name`` (id, facet, term) of a table."""
    return f"""{name}_text AS (SELECT {key} AS id, {FOLD.format(c="text")} AS text FROM {source}),
    {grams_sql(name + "_g", name + "_text", "id")},
    {name} AS (SELECT t.id, v.facet, v.term FROM (SELECT DISTINCT id, term FROM {name}_g) g JOIN vocab v USING (term) JOIN {name}_text t ON t.id = g.id WHERE {HAS})"""


FACETS = f"""{VOCABULARY},
    {facet_sql("df", "documents", "doc_id")},
    {facet_sql("qf", "benchmark", "item_id")},
    dn AS (SELECT id, facet, count(*) AS n FROM df GROUP BY ALL),
    qn AS (SELECT id, facet, count(*) AS n FROM qf GROUP BY ALL),
    fshare AS (SELECT q.id AS query, d.id, facet, count(*) AS shared, string_agg(term, ', ' ORDER BY term) AS terms
               FROM qf q JOIN df d USING (facet, term) GROUP BY ALL),
    overlap AS (SELECT s.query, s.id, s.facet, s.shared, s.terms, s.shared / (qn.n + dn.n - s.shared) AS similarity
                FROM fshare s JOIN qn ON qn.id = s.query AND qn.facet = s.facet JOIN dn ON dn.id = s.id AND dn.facet = s.facet)"""

EVIDENCE = """votes AS (SELECT d.doc_id, d.source, CASE l.quality WHEN 1 THEN 'HIGH' WHEN 0 THEN 'LOW' END AS level
               FROM documents d LEFT JOIN labels l USING (doc_id)),
    counts AS (SELECT source, level, count(*) AS n, min(doc_id) AS first FROM votes WHERE level IS NOT NULL GROUP BY ALL),
    reliability AS (SELECT source, arg_max(level, (n, -first)) AS level FROM counts GROUP BY source),
    strength AS (SELECT d.doc_id AS id,
                 ((trim(coalesce(d.text, '')) <> '')::INT + (trim(coalesce(d.lang, '')) <> '')::INT + (trim(coalesce(d.source, '')) <> '')::INT) / 3.0::DOUBLE
                 * CASE coalesce(r.level, 'NO_CATALOGADO') WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.7::DOUBLE WHEN 'LOW' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END AS evidence
                 FROM documents d LEFT JOIN reliability r ON r.source IS NOT DISTINCT FROM d.source)"""

SIGNALS = f"""{LEXICAL}, {FACETS}, {EVIDENCE},
    semantic AS (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
                 FROM embeddings a JOIN benchmark i ON i.item_id = a.vec_id, embeddings b),
    signals AS (SELECT i.item_id AS query, d.doc_id AS id, coalesce(s.similarity, 0) AS semantic, coalesce(x.similarity, 0) AS lexical,
                coalesce(ft.similarity, 0) AS topic, coalesce(fd.similarity, 0) AS domain, coalesce(fm.similarity, 0) AS method, e.evidence
                FROM benchmark i CROSS JOIN documents d
                LEFT JOIN semantic s ON s.query = i.item_id AND s.id = d.doc_id
                LEFT JOIN lexical x ON x.query = i.item_id AND x.id = d.doc_id
                LEFT JOIN overlap ft ON ft.query = i.item_id AND ft.id = d.doc_id AND ft.facet = 'topic'
                LEFT JOIN overlap fd ON fd.query = i.item_id AND fd.id = d.doc_id AND fd.facet = 'domain'
                LEFT JOIN overlap fm ON fm.query = i.item_id AND fm.id = d.doc_id AND fm.facet = 'method'
                JOIN strength e ON e.id = d.doc_id)"""


def hybrid_sql(semantic: float = 0.35, lexical: float = 0.15, topic: float = 0.25, domain: float = 0.10, method: float = 0.10, evidence: float = 0.05) -> str:
    """CTE ``scored`` (query, id, raw, lone, total) over ``signals``."""
    raw = f"{semantic}::DOUBLE * semantic + {lexical}::DOUBLE * lexical + {topic}::DOUBLE * topic + {domain}::DOUBLE * domain + {method}::DOUBLE * method + {evidence}::DOUBLE * evidence"
    return f"""scored AS (SELECT *, CASE WHEN lone THEN raw * 0.5::DOUBLE ELSE raw END AS total
               FROM (SELECT *, {raw} AS raw, topic = 0 AND method > 0 AS lone FROM signals))"""


BAND = "CASE WHEN {c} >= 0.45 THEN 'Alta' WHEN {c} >= 0.25 THEN 'Media' ELSE 'Baja' END"


def flow_band(c: str) -> str:
    return BAND.format(c=c)
