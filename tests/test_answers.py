"""Citations, warnings, refusals, evaluation and the commands."""

import pytest
from pyspark.sql import functions as F

from gristmill.functions.vectors import hashed_embedding
from gristmill.operators import citations, prompts, rules
from gristmill.plans import commands
from gristmill.sources import curated, index_store
from tests.test_sources import CASES, DOCTRINE


def test_sentences_keep_their_citations(spark):
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(citations.sentences(F.col("t")).alias("s")).first().s
    assert cut("Un geste utile. [src p.3] Un autre ! [a p. 1] [b.c p.2]\nFin sans point") == ["Un geste utile. [src p.3]", "Un autre ! [a p. 1] [b.c p.2]", "Fin sans point"]
    assert cut("Voir [SRC p.\t12] pour cela... Puis [pas une citation. Suite") == ["Voir [SRC p.\t12] pour cela...", "Puis [pas une citation.", "Suite"]
    assert cut("[s p.1] seul. ") == ["[s p.1] seul."] or cut("[s p.1] seul. ")[0] == "[s p.1] seul."
    assert cut("") == [] and cut("...") == []


def test_problems_are_told_in_full(spark):
    answers = spark.createDataFrame([(1, "Bien. [s p.2] Mal. [s p.9] Faux. [x p.1]\nUne affirmation assez longue pour exiger une source, mais sans."), (2, "Bien. [s p.1]")], "qid long, answer string")
    hits = spark.createDataFrame([(1, "s", 1, 3), (1, "s", 5, 6), (2, "s", 1, 1)], "qid long, source_id string, page_from int, page_to int")
    got = {r.qid: r.answer for r in citations.annotated(answers, hits).collect()}
    assert got[2] == "Bien. [s p.1]"
    tail = got[1].split("détectés :\n")[1].split("\n")
    assert tail[:6] == ["  • page-hors-extrait : « s » a été transmis pour la ou les pages 1–6, pas la page 9", "    dans : [s p.9]", "  • source-inconnue : « x » ne fait pas partie des extraits transmis", "    dans : [x p.1]", "  • phrase-sans-source : affirmation sans citation", "    dans : Une affirmation assez longue pour exiger une source, mais sans."]
    assert got[1].rstrip().endswith("ci-dessous.")


def test_exempt_sentences_and_verdicts(spark):
    answers = spark.createDataFrame([(1, "# Un titre qui est bien assez long pour demander une source sinon\n- un point de liste qui est bien assez long pour demander une source\nDans le DOUTE il vaut toujours mieux s'abstenir de toute consommation\nCourt.")], "qid long, answer string")
    assert citations.unsourced(answers).count() == 0
    said = spark.createDataFrame([("Ce bolet est comestible.",), ("Vous pouvez les manger.",), ("Dans le doute, non.",)], "t string").select(rules.gives_verdict(F.col("t")).alias("v"), rules.is_prudent(F.col("t")).alias("p")).collect()
    assert [(r.v, r.p) for r in said] == [(True, False), (True, False), (False, True)]


def test_warnings_and_refusal(spark):
    doctrine = curated.doctrine(spark, DOCTRINE)
    found = spark.createDataFrame([(1, "b", True, 1), (1, "a", False, 2)], "qid long, rule string, by_question boolean, rank int")
    gaps = spark.createDataFrame([(1, 1980, 2010), (2, 1950, 2000)], "qid long, oldest int, newest int")
    got = {r.qid: r.warning for r in prompts.doctrine_warnings(found, doctrine, gaps).collect()}
    assert "‼ Titre  b (changement vers 2010)\n   PÉRIMÉ  : vieux texte\n   ACTUEL  : neuf\n   source  : d'où\n\n• A (changement vers 1990)\n   PÉRIMÉ  : o\n   ACTUEL  : n\n\nLes extraits proviennent" in got[1]
    assert "suivre la doctrine ACTUELLE" in got[1] and "PÉRIMÉ" not in got[2] and "entre 1950 et 2000. Mentionne" in got[2] and all(w.endswith("pas un document.") for w in got.values())
    (human,) = prompts.human_warnings(found, doctrine).collect()
    assert human.warning.split("\n")[3] == "‼ Titre  b  (changement vers 2010)" and human.warning.endswith("    Actuel : n\n")
    text = spark.createDataFrame([(["a", "b", "c", "d", "e", "f", "g"], 0.126)], "u array<string>, c double").select(prompts.refusal(prompts.REFUSAL, F.col("u"), F.col("c")).alias("x")).first().x
    assert text.startswith("Le corpus ne couvre pas") and text.endswith("Aucun ouvrage indexé ne contient « a », « b », « c », « d », « e », « f ». Couverture de la question : 13%.")


def test_checklist_texts(spark):
    lists = spark.createDataFrame([("sang", "Saignement", [], "Appuyer."), ("un-nom-vraiment-tres-long", "B", [], "x")], "name string, title string, triggers array<string>, body string")
    page = lists.select(prompts.checklist_page(F.col("title"), F.col("body")).alias("p")).first().p
    assert page == f"{'━' * 74}\n  SAIGNEMENT\n{'━' * 74}\n\nAppuyer.\n"
    text = prompts.checklist_summary(lists)
    assert "  sang                 Saignement\n  un-nom-vraiment-tres-long B" in text and prompts.checklist_summary(lists.where("false")).startswith("Aucune checklist")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    chunks = spark.createDataFrame([("s", 1, 1, 1, "Feu", "faire un feu de bois sec en forêt", 1.0, 1, "fr"), ("s", 2, 2, 2, "Eau", "eau bouillie et eau filtrée", 1.0, 2, "fr"), ("t", 1, 4, 5, "", "une tente contre la pluie et trois cordes", 0.5, 3, "fr")], "source_id string, ordinal int, page_from int, page_to int, section string, text string, quality double, priority int, lang string")
    sources = spark.createDataFrame([("s", "S", "A", 1960, "cc-by"), ("t", "T", "B", 2000, "cc-by")], "id string, title string, author string, date int, licence string")
    index_store.build(hashed_embedding(index_store.numbered(chunks), 64), sources, path, {"embed_model": "hashing-64"})
    return path


def test_commands(spark, index, tmp_path):
    engine, doctrine = commands.opened(spark, index), curated.doctrine(spark, DOCTRINE)
    text, code = commands.search(engine, "feu de bois")
    assert code == 0 and text.startswith(" 1. ") and "[s p.1] Feu" in text.split("\n")[0]
    text, _ = commands.ask(engine, "un feu et trois cordes", doctrine)
    assert "Mode extraits seuls" in text and "1. [s p.1]  S — A, 1960, p. 1" in text or "[t p.4]" in text
    assert "Sources publiées entre 1960 et 2000" in text
    text, _ = commands.ask(engine, "zzzz qqqq", doctrine)
    assert text.startswith("Le corpus ne couvre pas") and "0 passages" in text
    text, _ = commands.ask(engine, "feu de bois", doctrine, generate=lambda q: q.select("qid", F.lit("On fait un feu. [s p.1] Et [nope p.3]").alias("answer")))
    assert "source-inconnue" in text and "citations : 1/2 valides" in text
    assert '"source_id":"s"' in commands.ask(engine, "feu", doctrine, as_json=True)[0]
    text, _ = commands.info(spark, index)
    assert "hashing-64" in text and [x.split() for x in text.split("\n") if x[:2] in ("s ", "t ")] == [["s", "cc-by", "2"], ["t", "cc-by", "1"]]
    (tmp_path / "sang.md").write_text("---\ntitre: Saignement\ndeclencheurs: [saigne]\n---\nAppuyer.", encoding="utf-8")
    assert commands.urgence(spark, str(tmp_path), "il saigne")[0].startswith("━") and commands.urgence(spark, str(tmp_path), "")[1] == 0
    assert commands.urgence(spark, str(tmp_path), "zzzz")[1] == 1


def test_evaluation_as_one_plan(spark, index, tmp_path):
    (tmp_path / "sang.md").write_text("---\ntitre: Saignement\ndeclencheurs: [saigne]\n---\nAppuyer.", encoding="utf-8")
    from gristmill.sources import readers

    engine, cases, lists = commands.opened(spark, index), curated.golden_cases(spark, CASES), readers.checklists(spark, str(tmp_path))
    failed, summary, rate = engine.evaluate(cases, curated.doctrine(spark, DOCTRINE), lists)
    got = {(r.qid, r.control, r.blocking) for r in failed.collect()}
    assert rate is None and not any(q in (1, 4, 5) for q, *_ in got) and (3, "recherche", False) in got
    kinds = {r.kind: (r.cases, r.passed) for r in summary.collect()}
    assert kinds["recherche"] == (2, 1) and kinds["urgence"] == (1, 1) and kinds["refus"][0] == 1
    wrong = lambda q: q.select("qid", F.lit("C'est comestible. [nope p.1]").alias("answer"))
    failed, _, rate = engine.evaluate(cases, curated.doctrine(spark, DOCTRINE), lists, generate=wrong)
    assert any(r.control == "citations" and r.blocking for r in failed.collect()) and rate.first().percent == 0.0
    text, code = commands.evaluate(engine, cases, curated.doctrine(spark, DOCTRINE), lists)
    assert "recherche" in text and "1 cas non exécutés" in text and code in (0, 1)
