"""The whole search over the institutional data set: build once, then answer texts.

Build: entities, graph, vocabulary, facets and lexical index as tables, saved with a manifest.  Search: hybrid scores,
a diverse selection, people, groups, subjects and capabilities that follow from it, and opportunities; ``answer`` does
all of it for many texts at once.  Evaluation: ranking quality of whole searches, and of the ablation's variants.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findara.functions import evidence as ev
from findara.functions.scores import GROUP_ROLES, MMR_LAMBDA, POOL, RELIABILITY, RESEARCHER_ROLES, TOP_K, VARIANTS, WEIGHTS, YEARS, band, looked_up, recency
from findara.functions.text import digits, without_suffix
from findara.operators import evaluation, facets, graph, opportunities
from findara.operators.lexical import LexicalIndex
from findara.operators.propagation import best_of, bridged, contributions, matched, mode, spread
from findara.operators.ranking import hybrid, mmr, nearest, pool_likeness
from findara.operators.signals import signals as all_signals
from findara.session import written
from findara.sources import institution
from findara.sources.artifacts import fingerprint, get_or_build

TABLES = ["entities", "edges", "vocabulary", "facets", "terms", "weights", "strength"]
# What explanations call the components.
COMPONENT_NAMES = {"semantic": "semantico", "lexical": "lexico", "topic": "tema", "domain": "dominio", "method": "metodo", "evidence": "evidencia"}
DOCUMENTS = ("PROJECT", "THESIS", "PUBLICATION", "LINE")
# What the tables' contents follow from besides the rows: raised when the way they are built changes.
FORMAT = "2"
FACETS = ("topic", "domain", "method")
#: What a contribution's citation needs of its edge.
SAID = ["file", "record", "field"]


@dataclass
class Engine:
    """``vectors``: id, vector of every entity, or None; :func:`findara.functions.vectors.encoder` makes them."""

    tables: dict[str, DataFrame]
    vectors: DataFrame | None = None

    @classmethod
    def build(cls, spark: SparkSession, entities: DataFrame, relations: dict[str, DataFrame], votes: DataFrame | None, folder: str, vectors: DataFrame | None = None) -> Engine:
        """``votes``: file_name, reliability_level of a source catalogue.

        Saved tables are reused if entities, relations and votes are the same in all columns.
        """
        manifest = {"format": FORMAT}
        for name, df in {"entities": entities, "votes": votes, **relations}.items():
            if df is not None:
                digest = fingerprint(df.select(F.lit(name).alias("name"), F.to_json(F.struct(*sorted(df.columns))).alias("row")), "name", "row").first()
                manifest |= {f"{name}_rows": str(digest["rows"]), f"{name}_digest": digest["digest"]}
        tables = get_or_build(spark, folder, TABLES, manifest, lambda: cls._made(entities, relations, votes))
        return cls(tables, vectors)

    @staticmethod
    def _made(entities: DataFrame, relations: dict[str, DataFrame], votes: DataFrame | None) -> dict[str, DataFrame]:
        known = entities.select("id", "kind", "name")
        keys = []
        for kind, k in institution.KINDS.items():
            for column, _, label in k.foreign:
                rows = entities.filter(F.col("kind") == kind).select("id", F.col("fields")[column].alias(column))
                keys.append(graph.ForeignKey(rows, "id", column, label, k.file))
        tables = [graph.Relation(relations[name], src, dst, role, label, f"{name}.csv") for name, (src, dst, role, label) in institution.RELATIONS.items() if name in relations]
        parts = []
        for facet, fields in institution.VOCABULARY.items():
            for kind, column in fields:
                rows = entities.filter(F.col("kind") == kind)
                one = column in institution.KINDS[kind].phrases or column not in institution.KINDS[kind].lists
                term = F.explode(F.array(F.col("fields")[column])) if one else F.explode("lists." + column)
                parts.append((facet, rows.select(term.alias("term")).filter("term is not null")))
        vocabulary = facets.vocabulary(parts)
        index = LexicalIndex.fit(entities, "id", "text")
        return {
            "entities": entities, "edges": graph.edges(known, keys, tables), "vocabulary": vocabulary, "facets": facets.extract(entities, vocabulary, "id", "text"),
            "terms": index.terms, "weights": index.weights, "strength": Engine._strength(entities, votes),
        }

    @staticmethod
    def _strength(entities: DataFrame, votes: DataFrame | None) -> DataFrame:
        """``id, evidence``: complete fields, reliable file, recent year."""
        complete, file, dated = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(False)
        for kind, k in institution.KINDS.items():
            of = F.col("kind") == kind
            full = F.size(F.filter(F.array(*[F.coalesce(F.col("fields")[c], F.lit("")) for c in k.semantic]), lambda x: x != "")) / F.lit(float(len(k.semantic)))
            complete, file = F.when(of, full).otherwise(complete), F.when(of, F.lit(k.file)).otherwise(file)
            dated = F.when(of, F.lit(k.year is not None)).otherwise(dated)
        rows = entities.select("id", "kind", complete.alias("complete"), file.alias("file"), digits(F.col("year")).alias("year"), dated.alias("dated"))
        ranges = rows.groupBy("kind").agg(F.coalesce(F.min("year"), F.lit(YEARS[0])).alias("least"), F.coalesce(F.max("year"), F.lit(YEARS[1])).alias("most"))
        rows = rows.join(F.broadcast(ranges), "kind")  # a row a kind
        fresh = F.when(F.col("dated"), recency(F.col("year"), F.col("least"), F.col("most"))).otherwise(1.0)
        if votes is None:
            level = F.lit(institution.UNCATALOGUED)
        else:
            numbered = votes.select(F.col("file_name").alias("file"), F.col("reliability_level").alias("level"), F.monotonically_increasing_id().alias("n"))
            rows = rows.join(mode(numbered, "file", "level", "n"), "file", "left")
            level = F.coalesce("level", F.lit(institution.UNCATALOGUED))
        return rows.select("id", (F.coalesce("complete", F.lit(0.5)) * looked_up(level, RELIABILITY, 0.6) * fresh).alias("evidence"))

    def signals(self, queries: DataFrame, kinds: tuple[str, ...], vectors: DataFrame | None = None) -> DataFrame:
        """``query, id, kind, name, ...`` of every query (query, text) and entity of the kinds; ``vectors``: query, vector.

        Queries without a text have none.
        """
        t = self.tables
        queries = queries.filter(F.trim("text") != "")
        corpus = t["entities"].filter(F.col("kind").isin(*kinds)).select("id", "kind", "name", "fields", "year").join(t["strength"], "id")
        asked = queries.select("query")
        if self.vectors is not None and vectors is not None:
            corpus = corpus.join(self.vectors.select("id", "vector"), "id", "left")
            asked = asked.join(vectors.select("query", F.col("vector").alias("asked_vector")), "query", "left")
        ids = corpus.select("id")
        index = LexicalIndex(t["terms"], t["weights"].join(ids, "id", "left_semi"))
        found = facets.extract(queries, t["vocabulary"], "query", "text")
        return all_signals(corpus, asked, index.weights, index.asked(queries, "query", "text"), t["facets"].join(ids, "id", "left_semi"), found)

    def search(self, queries: DataFrame, vectors: DataFrame | None = None, kinds: tuple[str, ...] = DOCUMENTS, k: int = TOP_K, weights: dict[str, float] = WEIGHTS, diversity: float = MMR_LAMBDA) -> DataFrame:
        """The k results of each query with ``rank`` and the shared terms ``t_topic, ...``; diverse by semantic vectors,
        or by lexical ones where there are none.  A blank text has no results."""
        scored = hybrid(self.signals(queries, kinds, vectors), weights, semantic=self.vectors is not None and vectors is not None)
        order = Window.partitionBy("query").orderBy(F.desc("total"), "id")
        most = max(POOL, k)
        pool = written(scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most), "pool")
        if diversity == 1.0:
            return self._with_terms(pool.filter(F.col("place") <= k).withColumnRenamed("place", "rank"), queries)
        items = pool.select("query", "id", F.col("total").alias("score"))
        if self.vectors is not None:
            chosen = mmr(items.join(self.vectors, "id", "left"), k, diversity, most=most)
        else:
            chosen = mmr(pool_likeness(items, self.tables["weights"], most), k, diversity, most=most, by_place=True)
        return self._with_terms(pool.drop("place").join(chosen.select("query", "id", "rank"), ["query", "id"]), queries)

    def _with_terms(self, results: DataFrame, queries: DataFrame) -> DataFrame:
        """Add the terms that each result shares with its query, by facet."""
        found = facets.extract(queries, self.tables["vocabulary"], "query", "text").withColumnRenamed("id", "query")
        mine = self.tables["facets"].join(F.broadcast(results.select("id").distinct()), "id", "left_semi")  # k rows a query
        shared = results.select("query", "id").join(mine, "id").join(found, ["query", "facet", "term"])
        told = shared.groupBy("query", "id").agg(*[F.array_sort(F.collect_set(F.when(F.col("facet") == f, F.col("term")))).alias(f"t_{f}") for f in FACETS])
        return results.join(told, ["query", "id"], "left")

    def _citations(self, dataset: str, most: int = 3) -> Column:
        """Citations of an entity's first fields."""
        cites = F.array().cast("array<string>")
        for kind, k in institution.KINDS.items():
            fields = {c: F.coalesce(F.col("fields")[c], F.lit("")) for c in k.semantic}
            told = F.transform(ev.top_fields(k.layer, k.file, F.col("id"), fields, most), lambda e: ev.citation(e["provenance"], dataset))
            cites = F.when(F.col("kind") == kind, told).otherwise(cites)
        return cites

    @staticmethod
    def _told(rows: DataFrame, dataset: str, parts: dict[str, Column], nature: Column, penalised: Column, terms: str) -> DataFrame:
        """Add ``explanation`` to rows that have relation, name, kind, id, total, band and citations."""
        components = F.create_map(*[x for name, c in parts.items() for x in (F.lit(name), c)])
        return rows.withColumn("explanation", ev.explanation(
            ev.opening(F.col("relation"), F.col("name"), F.col("kind"), F.col("id"), F.col("total"), F.col("band")), terms,
            ev.factors(components, penalised), ev.nature_sentence(nature, dataset), ev.cited(F.col("citations")),
        ))

    def explained(self, results: DataFrame, dataset: str) -> DataFrame:
        """Results with ``citations`` of their first fields and an ``explanation``."""
        parts = {told: F.col(f"c_{name}") for name, told in COMPONENT_NAMES.items()}
        terms = ev.shared_terms({f: F.col(f"t_{f}") for f in FACETS})
        return self._told(results.withColumn("citations", self._citations(dataset)), dataset, parts, F.lit("inferida"), F.col("penalty") != 0, terms)

    def explained_spread(self, rows: DataFrame, dataset: str) -> DataFrame:
        """People or groups with ``citations`` of the edges that led to them, the best source first."""
        cites = F.transform("sources_said", lambda s: F.concat_ws(" / ", F.lit(dataset), s["file"], s["record"], s["field"]))
        rows = rows.withColumn("citations", cites).withColumn("relation", F.lit("propagada_por_autoria"))
        parts = {"evidencia_directa": F.col("direct"), "afinidad_perfil_inferida": F.col("affinity")}
        return self._told(rows, dataset, parts, F.col("nature"), F.lit(False), F.lit(""))

    def explained_subjects(self, rows: DataFrame, dataset: str) -> DataFrame:
        """Subjects with ``citations`` of two fields and, if a program leads to them, of that."""
        program = F.concat_ws(" / ", F.lit(dataset), F.lit(institution.KINDS["SUBJECT"].file), "id", F.lit("program_id"))
        cites = F.concat(self._citations(dataset, 2), F.when(F.col("nature") == "mixta", F.array(program)).otherwise(F.array().cast("array<string>")))
        rows = rows.withColumn("citations", cites).withColumn("relation", F.lit("articulacion_curricular"))
        parts = {"puente_programa_compartido": F.round("bridge", 4), "afinidad_semantica_inferida": F.round("affinity", 4)}
        return self._told(rows, dataset, parts, F.col("nature"), F.lit(False), F.lit(""))

    def explained_capabilities(self, rows: DataFrame, dataset: str) -> DataFrame:
        rows = rows.withColumn("citations", self._citations(dataset, 2)).withColumn("relation", F.lit("capacidad_activable"))
        parts = {"afinidad_semantica": F.round("affinity", 4), "solape_dominio": F.round("overlap", 4)}
        return self._told(rows, dataset, parts, F.lit("inferida"), F.lit(False), F.lit(""))

    def answer(self, queries: DataFrame, dataset: str, vectors: DataFrame | None = None, kinds: tuple[str, ...] = DOCUMENTS, k: int = TOP_K, weights: dict[str, float] = WEIGHTS) -> dict[str, DataFrame]:
        """All there is to say to every text (query, text[, need]): results, researchers, groups, subjects and
        capabilities, each with citations and an explanation, and opportunities.  The need's priority is MEDIUM
        where none is given; blank texts get nothing."""
        queries = queries.filter(F.trim("text") != "")
        need = F.coalesce("need", F.lit("MEDIUM")) if "need" in queries.columns else F.lit("MEDIUM")
        needs = queries.select("query", need.alias("need"))
        kept = lambda df, name: written(df, name)
        results = kept(self.search(queries, vectors, kinds, k, weights), "results")
        researchers, groups = kept(self.researchers(results, k, vectors), "researchers"), kept(self.groups(results, k, vectors), "groups")
        subjects, capabilities = kept(self.subjects(queries, results, k, vectors), "subjects"), kept(self.capabilities(queries, k, vectors), "capabilities")
        of = lambda df: df.join(needs, "query")
        return {
            "results": self.explained(results, dataset), "researchers": self.explained_spread(researchers, dataset), "groups": self.explained_spread(groups, dataset),
            "subjects": self.explained_subjects(subjects, dataset), "capabilities": self.explained_capabilities(capabilities, dataset),
            "opportunities": self.opportunities(None, of(results), of(researchers), of(subjects), of(capabilities)),
        }

    def evaluate(self, queries: DataFrame, relevant: DataFrame, vectors: DataFrame | None = None, kinds: tuple[str, ...] = DOCUMENTS, k: int = TOP_K, weights: dict[str, float] = WEIGHTS, diversity: float = MMR_LAMBDA) -> DataFrame:
        """Ranking metrics of a whole search for each query of the reference ``relevant`` (query, id)."""
        asked = queries.join(relevant.select("query").distinct(), "query", "left_semi")
        ranking = self.search(asked, vectors, kinds, k, weights, diversity).select("query", "id", "rank")
        return evaluation.metrics(ranking, relevant, k)

    def ablation(self, queries: DataFrame, relevant: DataFrame, vectors: DataFrame | None = None, kinds: tuple[str, ...] = DOCUMENTS, k: int = TOP_K) -> DataFrame:
        """``variant, ndcg``: the mean of each variant's searches."""
        out = None
        for name, (weights, diversity) in VARIANTS.items():
            row = self.evaluate(queries, relevant, vectors, kinds, k, weights, diversity).agg(F.round(evaluation.mean(F.col("ndcg")), 4).alias("ndcg")).select(F.lit(name).alias("variant"), "ndcg")
            out = row if out is None else out.unionByName(row)
        return out

    def _spread(self, results: DataFrame, kind: str, labels: list[str], direction: str, roles: dict[str, float], k: int, vectors: DataFrame | None) -> DataFrame:
        t = self.tables
        out = None
        steps = graph.neighbours(results.select("id").distinct(), t["edges"], labels, direction)
        of_kind = t["entities"].filter(F.col("kind") == kind).select(F.col("id").alias("neighbour"), "name", "fields")
        steps = steps.join(of_kind.select("neighbour"), "neighbour", "left_semi")
        # A source's key is its query and id, so that one plan spreads the results of all queries.
        sources = results.select(F.struct("query", "id").alias("id"), F.col("total").alias("score"))
        keyed = steps.join(results.select("query", F.col("id").alias("of")), F.col("id") == F.col("of")).select(
            F.struct("query", "id").alias("id"), F.struct("query", "neighbour").alias("neighbour"), "role", "ordinal", *SAID
        )
        like = None
        if self.vectors is not None and vectors is not None:
            like = nearest(vectors, self.vectors).select(F.struct("query", F.col("id").alias("neighbour")).alias("neighbour"), "similarity")
        found = contributions(sources, keyed, roles, SAID).join(sources.withColumnRenamed("score", "source_score"), "id")
        said = F.struct((-F.col("source_score")).alias("s"), F.col("id.id").alias("source"), F.coalesce("role", F.lit("")).alias("role"), *SAID)
        said = found.groupBy("neighbour").agg(F.array_sort(F.collect_list(said)).alias("sources_said"))  # results of one query
        out = spread(found, like).join(said, "neighbour")
        out = out.select("neighbour.query", F.col("neighbour.neighbour").alias("id"), *[c for c in out.columns if c != "neighbour"])
        order = Window.partitionBy("query").orderBy(F.desc("total"), "id")
        named = out.join(of_kind.withColumnRenamed("neighbour", "id"), "id").withColumn("kind", F.lit(kind))
        return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def researchers(self, results: DataFrame, k: int = TOP_K, vectors: DataFrame | None = None) -> DataFrame:
        return self._spread(results, "RESEARCHER", ["participa_en_proyecto", "dirige_tesis", "autor_de_publicacion"], "in", RESEARCHER_ROLES, k, vectors)

    def groups(self, results: DataFrame, k: int = TOP_K, vectors: DataFrame | None = None) -> DataFrame:
        return self._spread(results, "GROUP", ["proyecto_grupo_ejecutor", "proyecto_ejecutado_por_grupo", "linea_de_grupo"], "out", GROUP_ROLES, k, vectors)

    def subjects(self, queries: DataFrame, results: DataFrame, k: int = TOP_K, vectors: DataFrame | None = None) -> DataFrame:
        """Subjects by a program they share with the results, or by likeness."""
        key = F.struct("query", F.col("fields")["program_id"].alias("program"))
        bridges = best_of(results.filter(F.coalesce(F.col("fields")["program_id"], F.lit("")) != "").withColumn("key", key), "key", "total")
        items = self.signals(queries, ("SUBJECT",), vectors).withColumn("key", key)
        out = bridged(items, bridges, "key", F.col("semantic"), F.col("lexical"))
        order = Window.partitionBy("query").orderBy(F.desc("total"), "id")
        return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("band", band(F.col("total")))

    def capabilities(self, queries: DataFrame, k: int = TOP_K, vectors: DataFrame | None = None) -> DataFrame:
        out = matched(self.signals(queries, ("CAPABILITY",), vectors), F.col("semantic"), F.col("lexical"), F.col("domain"))
        order = Window.partitionBy("query").orderBy(F.desc("total"), "id")
        return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def opportunities(self, need: str | None, results: DataFrame, researchers: DataFrame, subjects: DataFrame, capabilities: DataFrame) -> DataFrame:
        """Opportunities of each query's results, in order of priority; ``need``: its priority, or None if the rows have it."""
        by, priority = ["query", "need"], F.col("need")
        if need is not None:
            results, researchers, subjects, capabilities = (df.withColumn("need", F.lit(need)) for df in (results, researchers, subjects, capabilities))
        t = self.tables
        entities = t["entities"]
        theses = results.filter("kind = 'THESIS'").select(*by, "id", "name", digits(F.col("year")).alias("year"), F.col("total").alias("score"), "rank")
        active = entities.filter("kind = 'GROUP'").filter(F.col("fields")["status"] == "ACTIVE")
        # Only the graph around the results is walked.
        near = t["edges"].filter("label <> 'dirige_tesis'").unionByName(t["edges"].filter("label = 'dirige_tesis'").join(F.broadcast(theses.select(F.col("id").alias("dst")).distinct()), "dst", "left_semi"))
        walk = graph.two_steps(near, "dirige_tesis", "miembro_de_grupo", active)
        name_of = lambda c: entities.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
        directed = walk.join(name_of("via"), "via").join(name_of("end"), "end").withColumn("ordinal", F.lit(0))
        people = researchers.select(*by, "id", "name", F.col("fields")["faculty_id"].alias("unit"), F.col("total").alias("score"), "rank")
        program = F.col("fields")["program_id"].alias("program")
        sources = results.select(*by, program, F.col("total").alias("score"), "rank").filter("program is not null and program <> ''")
        sources = sources.join(entities.select(F.col("id").alias("program"), F.col("name").alias("program_name")), "program")
        taught = subjects.select(*by, "id", "name", program, F.col("total").alias("score"), "rank")
        able = capabilities.select(
            *by, "id", "name", F.concat_ws("|", without_suffix(F.col("fields")["capability_name"]), F.col("fields")["responsible_unit"]).alias("base"),
            digits(F.col("fields")["maturity_level"]).alias("maturity"), (F.col("fields")["status"] == "ACTIVE").alias("active"), F.col("total").alias("score"), "rank",
        )
        year = digits(F.col("year"))
        years = entities.filter("kind = 'THESIS'").agg(F.coalesce(F.min(year), F.lit(YEARS[0])).alias("least"), F.coalesce(F.max(year), F.lit(YEARS[1])).alias("most"))
        return opportunities.combined([
            opportunities.continuity(theses, directed, priority, by), opportunities.collaboration(people, priority, by), opportunities.integration(sources, taught, priority, by),
            opportunities.activation(able, priority, by), opportunities.renewal(theses, years, priority, by),
        ], by)


def phases(results: Column, people: Column, groups: Column, integrations: Column, subjects: Column) -> Column:
    """The states of a learning path's four phases, from how many rows each step has."""
    done = lambda c: F.when(c, "completado").otherwise("pendiente")
    third = F.when((integrations > 0) | (subjects > 0), "activo").otherwise("pendiente")
    return F.array(done(results > 0), done((people > 0) | (groups > 0)), third, F.lit("pendiente"))


