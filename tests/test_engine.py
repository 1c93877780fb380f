"""A tiny institution, from files to opportunities."""

import os

import pytest
from pyspark.sql import functions as F

from findara.operators import graph
from findara.plans.engine import Engine, phases
from findara.sources import institution
from findara.sources.artifacts import fingerprint, load

FILES = {
    "FACULTY": "faculty_id,faculty_name,description,strategic_focus\nF1,Salud,desc,a;b\nF2,Artes,,\n",
    "PROGRAM": "program_id,faculty_id,program_name,description\nPR1,F1,Medicina,programa de salud\nPR2,F9,Danza,\n",
    "GROUP": "group_id,group_name,faculty_id,description,mission,main_area,status\nG1,Grupo Uno,F1,salud,,,ACTIVE\nG2,Grupo Dos,,x,,,INACTIVE\n",
    "LINE": "line_id,group_id,line_name,description,keywords\nL1,G1,Línea,desc,redes;neuronales;clínicas\n",
    "CAPABILITY": "capability_id,capability_name,capability_type,description,responsible_unit,available_resources,application_domains,maturity_level,status\nC1,Laboratorio — capacidad 01,X,imagen médica diagnóstico,F1,r1;r2,imagen médica,4,ACTIVE\nC2,Laboratorio — capacidad 02,Y,imagen médica diagnóstico,F1,r1,imagen médica,5,ACTIVE\n",
    "RESEARCHER": "researcher_id,full_name,profile_summary,research_interests,methodological_expertise,application_domains,faculty_id,primary_program_id\nR1,Ana,imagen médica,redes neuronales,aprendizaje automático,imagen médica,F1,PR1\nR2,Beto,danza,arte,etnografía,escena,F2,PR2\n",
    "EXPERTISE": "expertise_id,researcher_id,expertise_name,expertise_type,evidence_source\nE1,R1,imagen,TIPO,cv\n",
    "SUBJECT": "subject_id,program_id,subject_name,description,purpose,main_topics,disciplinary_area\nS1,PR1,Radiología,imagen médica diagnóstico,,diagnóstico por imagen;imagen médica,salud\nS2,PR2,Coreografía,cuerpo y escena,,cuerpo,arte\n",
    "COMPETENCY": "competency_id,program_id,subject_id,competency_type,description\nK1,PR1,S1,T,d\n",
    "OUTCOME": "outcome_id,subject_id,outcome_description,cognitive_level,evidence_type\nO1,S1,d,l,e\n",
    "NEED": 'need_id,title,description,context,expected_impact,priority\nN1,Diagnóstico por imagen,"usar redes neuronales, ""pronto""",hospital,mejor,HIGH\n',
    "PROJECT": "project_id,faculty_id,program_id,group_id,title,problem_statement,abstract,general_objective,methodology,expected_results,application_context,keywords,end_year\nP1,F1,PR1,G1,Diagnóstico por imagen con redes neuronales,p,imagen médica,o,aprendizaje automático,r,hospital,redes neuronales;diagnóstico por imagen,2020\nP2,F2,PR2,G2,Danza y memoria,p,cuerpo,o,etnografía,r,teatro,memoria corporal,x\n",
    "THESIS": "thesis_id,program_id,title,abstract,problem_statement,general_objective,methodology,main_results,conclusions,application_context,keywords,graduation_year\nT1,PR1,Redes neuronales en radiología,diagnóstico por imagen,p,o,m,r,c,hospital,redes neuronales,2016\nT2,PR2,Otra,x,p,o,m,r,c,teatro,escena,2024\n",
    "PUBLICATION": "publication_id,related_project_id,title,abstract,keywords,researchers,year\nB1,P1,Un artículo,redes neuronales,redes neuronales,R1;R2,2021\n",
}
RELATIONS = {
    "researcher_group": "researcher_id,group_id,role\nR1,G1,LEADER\nR2,G2,MEMBER\n", "researcher_project": "researcher_id,project_id,role\nR1,P1,PI\nR2,P1,CO_INVESTIGATOR\nR2,P2,PI\nR9,P1,PI\n",
    "thesis_advisor": "thesis_id,researcher_id,role\nT1,R1,ADVISOR\n", "project_group": "project_id,group_id,relation\nP1,G1,EXECUTING_GROUP\n",
    "publication_project": "publication_id,project_id,relation\nB1,P1,DERIVED_FROM\n", "publication_researcher": "publication_id,researcher_id,role\nB1,R1,AUTHOR\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("institution")
    for kind, text in FILES.items():
        k = institution.KINDS[kind]
        os.makedirs(root / k.layer, exist_ok=True)
        (root / k.layer / k.file).write_bytes(b"\xef\xbb\xbf" + text.encode())
    for name, text in RELATIONS.items():
        (root / institution.RELATION_LAYER / f"{name}.csv").write_text(text)
    os.makedirs(root / "documents" / "deep")
    (root / "documents" / "deep" / "p1.md").write_text("# Perfil\n\ntexto")
    (root / "documents" / "stray.md").write_text("x")
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    votes = spark.createDataFrame([("projects.csv", "HIGH"), ("projects.csv", "LOW"), ("projects.csv", "HIGH"), ("theses.csv", "LOW")], "file_name string, reliability_level string").coalesce(1)
    return Engine.build(spark, institution.load(spark, folder), institution.relations(spark, folder), votes, str(tmp_path_factory.mktemp("engine") / "tables"))


@pytest.fixture(scope="module")
def need(spark):
    return spark.createDataFrame([("N1", "Diagnóstico por imagen con redes neuronales en hospital")], "query string, text string")


def test_loading(spark, folder):
    rows = {r["id"]: r for r in institution.load(spark, folder).collect()}
    assert len(rows) == 22 and rows["F1"]["fields"]["faculty_id"] == "F1" and rows["F1"]["lists"]["strategic_focus"] == ["a", "b"]
    assert rows["F1"]["text"] == "Salud . desc . a b" and rows["F2"]["text"] == "Artes" and rows["L1"]["text"].endswith("redes neuronales clínicas")
    assert rows["N1"]["fields"]["description"] == 'usar redes neuronales, "pronto"' and rows["R1"]["name"] == "Ana" and rows["E1"]["name"] == "E1" and rows["T1"]["year"] == "2016"
    files = institution.text_files(spark, folder)
    catalogue = spark.createDataFrame([("p1.md", "PROJECT", "P1"), ("lost.md", "PROJECT", "P2")], "file_name string, entity_type string, entity_id string")
    attached = institution.with_documents(institution.load(spark, folder), files, catalogue).filter("document_text is not null").collect()
    assert [(r["id"], r["document_text"]) for r in attached] == [("P1", "# Perfil\n\ntexto")]


def test_graph_and_vocabulary(engine):
    e = engine.tables["edges"]
    counts = {r["label"]: r["count"] for r in e.groupBy("label").count().collect()}
    assert counts["pertenece_a_facultad"] == 1 and counts["grupo_de_facultad"] == 1 and counts["participa_en_proyecto"] == 3 and counts["dirige_tesis"] == 1 and counts["expertise_de_investigador"] == 1
    assert graph.dangling(e, engine.tables["entities"]).count() == 0
    vocab = {(r["facet"], r["term"]) for r in engine.tables["vocabulary"].collect()}
    assert {("topic", "redes neuronales clinicas"), ("topic", "redes neuronales"), ("method", "aprendizaje automatico"), ("domain", "imagen medica"), ("domain", "hospital")} <= vocab
    strength = {r["id"]: r["evidence"] for r in engine.tables["strength"].collect()}
    assert strength["P1"] == pytest.approx(1.0 * 1.0 * 0.6) and strength["P2"] == pytest.approx(0.8) and strength["T1"] == pytest.approx(0.4 * 0.6) and strength["F2"] == pytest.approx(0.6 / 3)


def test_search_and_what_follows(spark, engine, need):
    results = engine.search(need).cache()
    rows = results.orderBy("rank").collect()
    assert "P1" in [r["id"] for r in rows[:3]] and [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and {r["kind"] for r in rows} <= {"PROJECT", "THESIS", "PUBLICATION", "LINE"}
    people = engine.researchers(results).cache()
    by = {r["id"]: r for r in people.collect()}
    score = {r["id"]: r["total"] for r in rows}
    assert by["R1"]["direct"] == pytest.approx(0.6 * (score["P1"] + score["T1"] + 0.8 * score["B1"]), abs=1e-3) and by["R1"]["nature"] == "explicita" and by["R1"]["rank"] == 1
    groups = {r["id"]: r["direct"] for r in engine.groups(results).collect()}
    assert groups["G1"] == pytest.approx(0.36 * (score["P1"] + score["L1"]), abs=1e-3)  # key and table of P1 count once
    subjects = engine.subjects(need, results).cache()
    assert {r["id"]: r["nature"] for r in subjects.collect()}["S1"] == "mixta"
    able = engine.capabilities(need).cache()
    found = engine.opportunities("HIGH", results, people, subjects, able).orderBy("position").collect()
    kinds = {r["type"]: r["related"] for r in found}
    assert kinds["RESEARCH_CONTINUITY"] == ["T1", "R1", "G1"] and kinds["COLLABORATION"] == ["R1", "R2"]
    assert [r["priority"] for r in found] == sorted((r["priority"] for r in found), key=["Alta", "Media", "Baja"].index)


def test_explanations(engine, need):
    told = {r["id"]: r for r in engine.explained(engine.search(need), "set").collect()}
    assert told["P1"]["citations"] == [f"set / projects.csv / P1 / {c}" for c in ("title", "problem_statement", "abstract")]
    text = told["P1"]["explanation"]
    assert text.startswith("Diagnóstico por imagen con redes neuronales (proyecto P1) se identifica como antecedente relevante (score ")
    assert "tema: diagnostico por imagen, redes neuronales" in text and text.endswith("Evidencia: set / projects.csv / P1 / title | set / projects.csv / P1 / problem_statement.")


def test_vectors_and_diversity(spark, engine, need):
    ids = [r["id"] for r in engine.tables["entities"].select("id").collect()]
    vectors = spark.createDataFrame([(i, [1.0, float(k % 3)]) for k, i in enumerate(sorted(ids))], "id string, vector array<double>")
    asked = spark.createDataFrame([("N1", [1.0, 0.5])], "query string, vector array<double>")
    rich = Engine(engine.tables, vectors)
    rows = rich.search(need, asked, k=4).orderBy("rank").collect()
    assert len(rows) == 4 and len({r["id"] for r in rows}) == 4 and all(r["c_semantic"] > 0 for r in rows)
    assert [r["id"] for r in rich.search(need, asked, k=4, diversity=1.0).orderBy("rank").collect()] == [r["id"] for r in rich.search(need, asked, k=50, diversity=1.0).orderBy("rank").collect()][:4]
    assert rich.researchers(rich.search(need, asked), vectors=asked).first()["nature"] == "mixta"


def test_artifacts(spark, tmp_path, engine):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    digest = lambda d: tuple(fingerprint(d, "id", "text").first())
    assert digest(df) == digest(df.repartition(3).orderBy(F.desc("id"))) != digest(df.withColumn("text", F.lit("a"))) and digest(df.limit(0))[0] == 0
    from findara.sources.artifacts import get_or_build

    built = []

    def build():
        built.append(1)
        return {"t": df}

    for manifest, times in (({"k": "1"}, 1), ({"k": "1"}, 1), ({"k": "2"}, 2)):
        assert get_or_build(spark, str(tmp_path / "a"), ["t"], manifest, build)["t"].count() == 2 and len(built) == times
    assert load(spark, str(tmp_path / "none"), ["t"], {}) is None


def test_phases(spark):
    state = lambda *n: spark.range(1).select(phases(*[F.lit(x) for x in n])).first()[0]
    assert state(1, 0, 1, 0, 1) == ["completado", "completado", "activo", "pendiente"] and state(0, 0, 0, 0, 0) == ["pendiente"] * 4


def test_answer_to_many_texts(spark, engine):
    """All in one call: each query has its own rows, blank ones none."""
    asked = spark.createDataFrame([("a", "Diagnóstico por imagen médica con redes neuronales", "HIGH"), ("b", "danza, cuerpo y memoria corporal en escena", None), ("c", "  ", "LOW")], "query string, text string, need string")
    found = engine.answer(asked, "set", k=5)
    rows = {name: df.collect() for name, df in found.items()}
    for name, rs in rows.items():
        assert {r["query"] for r in rs} <= {"a", "b"}, name
        if name != "opportunities":
            assert all(r["explanation"] and r["rank"] <= 5 for r in rs)
    assert {r["query"] for r in rows["results"]} == {"a", "b"}
    ana = next(r for r in rows["researchers"] if r["query"] == "a" and r["id"] == "R1")
    assert "set / researcher_project.csv / R1|P1 / role" in ana["citations"] and "autoría o dirección real" in ana["explanation"] and "Evidencia: set / " in ana["explanation"]
    subject = next(r for r in rows["subjects"] if r["query"] == "a" and r["id"] == "S1")
    assert subject["citations"][-1] == "set / subjects.csv / S1 / program_id" and "articulación curricular" in subject["explanation"]
    assert all("capacidad institucional activable" in r["explanation"] for r in rows["capabilities"]) and rows["capabilities"]
    alone = {q: engine.answer(asked.filter(F.col("query") == q), "set", k=5)["opportunities"].orderBy("position").collect() for q in "b"}
    for q in alone:
        assert sorted((r["position"], r["title"], r["priority"]) for r in rows["opportunities"] if r["query"] == q) == sorted((r["position"], r["title"], r["priority"]) for r in alone[q])
    assert {r["need"] for r in rows["opportunities"] if r["query"] == "b"} <= {"MEDIUM"}


def test_diversity_by_lexical_vectors(spark, engine, need):
    """Without semantic vectors, a greedy choice by hand over TF-IDF weights."""
    pool = {r["id"]: r["total"] for r in engine.search(need, k=50, diversity=1.0).collect()}
    weights = {}
    for r in engine.tables["weights"].collect():
        weights.setdefault(r["id"], {})[r["term"]] = r["w"]
    like = lambda a, b: sum(w * weights[b].get(t, 0.0) for t, w in weights[a].items())
    most, chosen = max(pool.values()), []
    while len(chosen) < 4:
        rest = sorted((i for i in pool if i not in chosen), key=lambda i: (-pool[i], i))
        chosen.append(max(rest, key=lambda i: 0.3 * pool[i] / most - 0.7 * max((like(i, c) for c in chosen), default=0.0)))
    got = engine.search(need, k=4, diversity=0.3).orderBy("rank").collect()
    assert [r["id"] for r in got] == chosen


def test_a_changed_relation_or_vote_is_a_new_graph(spark, folder, tmp_path):
    entities, relations = institution.load(spark, folder).filter("kind in ('RESEARCHER', 'PROJECT', 'FACULTY')"), institution.relations(spark, folder)
    build = lambda r, v=None: Engine.build(spark, entities, r, v, str(tmp_path / "t"))
    owners = lambda e: {r["src"] for r in e.tables["edges"].filter("label = 'participa_en_proyecto' and dst = 'P1'").collect()}
    first = build(relations)
    assert owners(first) == {"R1", "R2"}
    changed = relations | {"researcher_project": relations["researcher_project"].filter("researcher_id = 'R2'")}
    assert owners(build(changed)) == {"R2"} and owners(build(relations)) == {"R1", "R2"}


def test_evaluation_and_ablation(spark, engine, need):
    relevant = spark.createDataFrame([("N1", "P1"), ("N1", "T1"), ("N2", "P2")], "query string, id string")
    got = {r["query"]: r for r in engine.evaluate(need, relevant).collect()}
    assert got["N1"]["recall"] == 1.0 and 0 < got["N1"]["ndcg"] <= 1 and got["N2"]["ndcg"] == 0


def test_encoder(spark):
    import numpy as np

    from findara.functions.vectors import encoder, pooled

    f = encoder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), most=2)
    rows = spark.createDataFrame([("abc",), (None,), ("x",)], "t string").coalesce(1).select(f("t").alias("v")).collect()
    assert [r["v"] for r in rows] == [[3.0, 1.0], [0.0, 1.0], [1.0, 1.0]]
    assert pooled(np.array([[[1.0], [3.0], [9.0]]]), np.array([[1, 1, 0]])).tolist() == [[2.0]] and pooled(np.ones((1, 2, 1)), np.zeros((1, 2))).tolist() == [[0.0]]


def test_processed_tables_and_documents(spark, folder, tmp_path):
    with open(f"{folder}/{institution.CATALOGUE}", "w") as f:
        f.write("file_name,entity_type,entity_id\np1.md,PROJECT,P1\n")
    rows = institution.load_with_documents(spark, folder)
    assert {r["id"]: r["document_file"] for r in rows.filter("document_file is not null").collect()} == {"P1": "p1.md"}
    institution.save_processed(rows, institution.relations(spark, folder), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/entities")).filter("kind = 'THESIS'").count() == 2 and spark.read.parquet(str(tmp_path / "p/rel_thesis_advisor")).count() == 1
