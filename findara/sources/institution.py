"""The institutional data set: which file holds which kind of entity, and how it is read.

Every stored value is text.  Lists are separated by semicolons.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findara.functions.text import first_of, joined, mended, value, values


@dataclass(frozen=True)
class Kind:
    layer: str
    file: str
    key: str
    semantic: tuple[str, ...]
    lists: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    year: str | None = None
    foreign: tuple[tuple[str, str, str], ...] = field(default_factory=tuple)


# Files, keys, fields in the order they are read, lists, phrases that the files keep word by word,
# and foreign keys (column, kind it points to, label).
KINDS = {
    "FACULTY": Kind("01_institution", "faculties.csv", "faculty_id", ("faculty_name", "description", "strategic_focus"), ("strategic_focus",)),
    "PROGRAM": Kind("01_institution", "programs.csv", "program_id", ("program_name", "description", "disciplinary_area", "graduate_profile", "strategic_topics"), ("strategic_topics",), foreign=(("faculty_id", "FACULTY", "pertenece_a_facultad"),)),
    "GROUP": Kind("01_institution", "research_groups.csv", "group_id", ("group_name", "description", "mission", "main_area"), foreign=(("faculty_id", "FACULTY", "grupo_de_facultad"),)),
    "LINE": Kind("01_institution", "research_lines.csv", "line_id", ("line_name", "description", "keywords"), (), ("keywords",), foreign=(("group_id", "GROUP", "linea_de_grupo"),)),
    "CAPABILITY": Kind("01_institution", "institutional_capabilities.csv", "capability_id", ("capability_name", "capability_type", "description", "available_resources", "application_domains"), ("available_resources", "application_domains"), foreign=(("responsible_unit", "FACULTY", "capacidad_de_facultad"),)),
    "RESEARCHER": Kind("02_people_curriculum", "researchers.csv", "researcher_id", ("profile_summary", "research_interests", "methodological_expertise", "application_domains"), ("research_interests", "methodological_expertise", "application_domains"), foreign=(("faculty_id", "FACULTY", "investigador_de_facultad"), ("primary_program_id", "PROGRAM", "investigador_de_programa"))),
    "EXPERTISE": Kind("02_people_curriculum", "researcher_expertise.csv", "expertise_id", ("expertise_name", "expertise_type", "evidence_source"), foreign=(("researcher_id", "RESEARCHER", "expertise_de_investigador"),)),
    "SUBJECT": Kind("02_people_curriculum", "subjects.csv", "subject_id", ("subject_name", "description", "purpose", "main_topics", "disciplinary_area"), ("main_topics",), foreign=(("program_id", "PROGRAM", "pertenece_a_programa"),)),
    "COMPETENCY": Kind("02_people_curriculum", "competencies.csv", "competency_id", ("competency_type", "description"), foreign=(("program_id", "PROGRAM", "asociada_a_programa"), ("subject_id", "SUBJECT", "asociada_a_asignatura"))),
    "OUTCOME": Kind("02_people_curriculum", "learning_outcomes.csv", "outcome_id", ("outcome_description", "cognitive_level", "evidence_type"), foreign=(("subject_id", "SUBJECT", "resultado_de_asignatura"),)),
    "NEED": Kind("03_knowledge_needs", "institutional_needs.csv", "need_id", ("title", "description", "context", "expected_impact")),
    "PROJECT": Kind("03_knowledge_needs", "projects.csv", "project_id", ("title", "problem_statement", "abstract", "general_objective", "methodology", "expected_results", "application_context", "keywords"), ("keywords",), year="end_year", foreign=(("faculty_id", "FACULTY", "proyecto_de_facultad"), ("program_id", "PROGRAM", "proyecto_de_programa"), ("group_id", "GROUP", "proyecto_ejecutado_por_grupo"))),
    "THESIS": Kind("03_knowledge_needs", "theses.csv", "thesis_id", ("title", "abstract", "problem_statement", "general_objective", "methodology", "main_results", "conclusions", "application_context", "keywords"), ("keywords",), year="graduation_year", foreign=(("program_id", "PROGRAM", "tesis_de_programa"),)),
    "PUBLICATION": Kind("03_knowledge_needs", "publications.csv", "publication_id", ("title", "abstract", "keywords"), ("keywords", "researchers"), year="year", foreign=(("related_project_id", "PROJECT", "publicacion_deriva_de_proyecto"),)),
}
# Relation tables: file, source, destination and role columns, label.
RELATIONS = {
    "researcher_group": ("researcher_id", "group_id", "role", "miembro_de_grupo"),
    "researcher_project": ("researcher_id", "project_id", "role", "participa_en_proyecto"),
    "thesis_advisor": ("researcher_id", "thesis_id", "role", "dirige_tesis"),
    "project_group": ("project_id", "group_id", "relation", "proyecto_grupo_ejecutor"),
    "publication_project": ("publication_id", "project_id", "relation", "publicacion_de_proyecto"),
    "publication_researcher": ("researcher_id", "publication_id", "role", "autor_de_publicacion"),
}
RELATION_LAYER = "03_knowledge_needs"
# The catalogue of whole text files, and their folder.
CATALOGUE, DOCUMENTS = "03_knowledge_needs/document_catalog.csv", "documents"
NAMES = ("full_name", "title", "group_name", "program_name", "faculty_name", "line_name", "capability_name", "subject_name")
# Where the vocabulary's terms come from: facet to (kind, field).
VOCABULARY = {
    "topic": [("PROJECT", "keywords"), ("THESIS", "keywords"), ("PUBLICATION", "keywords"), ("SUBJECT", "main_topics"), ("LINE", "keywords")],
    "method": [("RESEARCHER", "methodological_expertise")],
    "domain": [("RESEARCHER", "application_domains"), ("CAPABILITY", "application_domains"), ("PROJECT", "application_context"), ("THESIS", "application_context")],
}
UNCATALOGUED = "NO_CATALOGADO"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file with a header line, with or without a byte order mark; every column is text."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)


def entities(df: DataFrame, kind: str) -> DataFrame:
    """``id, kind, fields`` (map of texts), ``lists`` (map of arrays), ``name, text, year``; missing columns are empty."""
    k = KINDS[kind]
    there = {c: mended(F.col(c)) if c in k.phrases else F.col(c) for c in df.columns}
    of = lambda c: value(there[c]) if c in there else F.lit("")
    text = lambda c: F.array_join(values(there[c]), " ") if c in k.lists and c in there else of(c)
    fields = F.create_map(*[x for c in df.columns for x in (F.lit(c), of(c))])
    lists = F.create_map(*[x for c in k.lists for x in (F.lit(c), values(there[c]) if c in there else F.array().cast("array<string>"))]) if k.lists else F.lit(None)
    name = first_of([there[c] for c in NAMES if c in there], F.col(k.key)) if any(c in there for c in NAMES) else F.col(k.key)
    return df.select(
        F.col(k.key).alias("id"), F.lit(kind).alias("kind"), fields.alias("fields"), lists.cast("map<string,array<string>>").alias("lists"),
        name.alias("name"), joined([text(c) for c in k.semantic]).alias("text"), (of(k.year) if k.year else F.lit(None)).cast("string").alias("year"),
    )


def load(spark: SparkSession, folder: str, kinds: list[str] | None = None) -> DataFrame:
    """Entities of all kinds, in one table; write it partitioned by ``kind`` to prune by kind."""
    out = None
    for kind in kinds or KINDS:
        k = KINDS[kind]
        rows = entities(read_csv(spark, f"{folder}/{k.layer}/{k.file}"), kind)
        out = rows if out is None else out.unionByName(rows)
    return out


def relations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_csv(spark, f"{folder}/{RELATION_LAYER}/{name}.csv") for name in RELATIONS}


def with_documents(rows: DataFrame, files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Attach whole text files: ``files`` (file_name, value), ``catalogue`` (file_name, entity_id); unknown ids are left out."""
    texts = catalogue.join(files, "file_name").select(F.col("entity_id").alias("id"), F.col("file_name").alias("document_file"), F.col("value").alias("document_text"))
    return rows.join(texts, "id", "left")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, value`` of every Markdown file, at any depth."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return found.select(F.col("_metadata.file_name").alias("file_name"), "value")


def load_with_documents(spark: SparkSession, folder: str, documents: str = DOCUMENTS) -> DataFrame:
    """Entities of all kinds with ``document_file, document_text`` of those that the catalogue gives a text file."""
    return with_documents(load(spark, folder), text_files(spark, f"{folder}/{documents}"), read_csv(spark, f"{folder}/{CATALOGUE}"))


def save_processed(rows: DataFrame, tables: dict[str, DataFrame], folder: str) -> None:
    """Entities as a Parquet table partitioned by kind, and a table for each relation."""
    rows.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/entities")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/rel_{name}")
