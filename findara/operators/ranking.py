"""Hybrid scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findara.functions.scores import METHOD_WITHOUT_TOPIC, MMR_LAMBDA, POOL, TOP_K, band, effective
from findara.functions.text import once
from findara.functions.vectors import cosine, norm

#: Queries that are asked at a time: the side that goes to every block of the corpus has no more rows.
MOST_QUERIES = 10_000


def component_columns(weights: dict[str, float], semantic: bool = True) -> list[Column]:
    """Weighted components from columns named like the weights (null: 0)."""
    return [(F.lit(float(w)) * F.coalesce(F.col(name), F.lit(0.0))).alias(f"c_{name}") for name, w in effective(weights, semantic).items()]


def hybrid(pairs: DataFrame, weights: dict[str, float], semantic: bool = True) -> DataFrame:
    """Add the components ``c_...``, ``penalty``, ``total``, ``relation`` and ``band``.

    A text that shares a method but no topic counts half and is a transferable method.
    """
    scored = pairs.select("*", *component_columns(weights, semantic))
    raw = sum((F.col(f"c_{name}") for name in effective(weights, semantic)), F.lit(0.0))
    lone = (F.coalesce("topic", F.lit(0.0)) == 0) & (F.coalesce("method", F.lit(0.0)) > 0)
    total = F.when(lone, raw * METHOD_WITHOUT_TOPIC).otherwise(raw)
    return (
        scored.withColumn("penalty", F.when(lone, raw * (METHOD_WITHOUT_TOPIC - 1)).otherwise(F.lit(0.0)))
        .withColumn("total", total)
        .withColumn("relation", F.when(lone, "metodo_transferible").otherwise("antecedente_relevante"))
        .withColumn("band", band(F.col("total")))
    )


def blocks(queries: DataFrame, least: int = 1) -> list[DataFrame]:
    """The queries (query, ...) in ``least`` blocks or more, of at most ``MOST_QUERIES`` rows, by a hash of ``query``.

    Rows of one ``query`` stay together.  Blocks are counted; if the largest is too large there are twice as many.
    """
    n = queries.count()
    parts = max(least, -(-n // MOST_QUERIES))
    if parts <= 1:
        return [queries]
    while True:
        block = F.pmod(F.xxhash64("query"), F.lit(parts))
        largest = queries.groupBy(block.alias("b")).agg(F.count("*").alias("n"), F.count_distinct("query").alias("d"))
        if not largest.filter((F.col("n") > MOST_QUERIES) & (F.col("d") > 1)).head(1):
            return [queries.filter(block == k) for k in range(parts)]
        parts *= 2


def beside(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row of the corpus with every query; block after block of queries goes to the corpus by broadcast."""
    out = None
    for block in blocks(queries):
        rows = corpus.join(F.broadcast(block))
        out = rows if out is None else out.unionByName(rows)
    return out


def nearest(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``query, id, similarity``: cosine of every query (query, vector) with every text (id, vector).

    The queries are the small side: they go to each block of the corpus, which is not moved.
    """
    q = queries.select("query", F.col("vector").alias("qv"), norm(F.col("vector")).alias("qn"))
    c = corpus.select("id", "vector", norm(F.col("vector")).alias("n"))
    return beside(c, q).select("query", "id", cosine(F.col("qv"), F.col("vector"), F.col("qn"), F.col("n")).alias("similarity"))


def pool_likeness(pool: DataFrame, weights: DataFrame, most: int = POOL) -> DataFrame:
    """The pool (query, id, score) with ``vector``: each item's likeness to those of its pool, by place, for
    :func:`mmr` with ``by_place``; from sparse unit vectors ``weights`` (id, term, w)."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    placed = pool.select("query", "id", "score").withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= most)
    terms = weights.join(placed.select("query", "id", "_p"), "id").select("query", "_p", "term", "w")
    other = terms.select("query", F.col("_p").alias("_o"), "term", F.col("w").alias("v"))
    likes = terms.join(other, ["query", "term"]).groupBy("query", "_p", "_o").agg(F.sum(F.col("w") * F.col("v")).alias("like"))
    likes = likes.groupBy("query", "_p").agg(F.map_from_entries(F.collect_list(F.struct("_o", "like"))).alias("likes"))  # most entries
    vector = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda o: F.coalesce(F.element_at("likes", o), F.lit(0.0)))
    return placed.join(likes, ["query", "_p"], "left").select("query", "id", "score", vector.alias("vector"))


def mmr(pool: DataFrame, k: int = TOP_K, weight: float | Column = MMR_LAMBDA, group: str = "query", most: int = POOL, by_place: bool = False) -> DataFrame:
    """``<group>, id, rank, mmr, score``: a greedy choice of k that weighs score against likeness to those chosen.

    ``pool``: group, id, score, vector.  The best max(most, k) rows a group are its pool; ties go by id.  A missing
    vector is unlike any other; ``by_place``: a vector holds the likeness to the item at each place of the pool.  The
    pool is the only thing gathered, in one row a group.
    """
    order = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    ranked = pool.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= max(most, k))
    item = F.struct("_place", "id", "score", F.col("vector").cast("array<double>").alias("v"), norm(F.col("vector")).alias("n"), F.lit(None).cast("double").alias("like"))
    gathered = ranked.withColumn("_lambda", weight if isinstance(weight, Column) else F.lit(float(weight))).groupBy(group, "_lambda").agg(F.array_sort(F.collect_list(item)).alias("rest"))
    best_score = F.array_max(F.transform("rest", lambda x: x["score"]))
    gathered = gathered.withColumn("_most", F.when(best_score == 0, F.lit(1.0)).otherwise(best_score))
    worth = lambda x: F.col("_lambda") * (x["score"] / F.col("_most")) - (1 - F.col("_lambda")) * F.coalesce(x["like"], F.lit(0.0))
    state = "struct<rest:array<struct<_place:int,id:bigint,score:double,v:array<double>,n:double,like:double>>,chosen:array<struct<id:bigint,mmr:double,score:double>>>"
    state = state.replace("id:bigint", f"id:{pool.schema['id'].dataType.simpleString()}")

    def step(s: Column, _: Column) -> Column:
        best = F.array_max(F.transform(s["rest"], lambda x: F.struct(worth(x).alias("mmr"), (-x["_place"]).alias("p"))))
        return F.when(F.size(s["rest"]) == 0, s).otherwise(once(best, lambda b: once(taken(s, b), lambda c: after(s, b, c))))

    def taken(s: Column, best: Column) -> Column:
        return F.element_at(F.filter(s["rest"], lambda x: x["_place"] == -best["p"]), 1)

    def after(s: Column, best: Column, chosen: Column) -> Column:
        near = lambda x: F.coalesce(F.get(x["v"], chosen["_place"] - 1), F.lit(0.0)) if by_place else cosine(x["v"], chosen["v"], x["n"], chosen["n"])
        liked = lambda x: F.greatest(F.coalesce(x["like"], F.lit(-2.0)), near(x))
        rest = F.transform(
            F.filter(s["rest"], lambda x: x["_place"] != chosen["_place"]),
            lambda x: F.struct(*[x[c].alias(c) for c in ("_place", "id", "score", "v", "n")], liked(x).alias("like")),
        )
        new = F.array(F.struct(chosen["id"].alias("id"), best["mmr"].alias("mmr"), chosen["score"].alias("score")))
        return F.struct(rest.alias("rest"), F.concat(s["chosen"], new).alias("chosen")).cast(state)

    start = F.struct(F.col("rest"), F.array().alias("chosen")).cast(state)
    picked = gathered.select(group, "_lambda", F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step)["chosen"].alias("chosen"))
    return picked.select(group, "_lambda", F.posexplode("chosen").alias("p", "c")).select(group, F.col("_lambda").alias("lambda"), "c.id", (F.col("p") + 1).alias("rank"), "c.mmr", "c.score")
