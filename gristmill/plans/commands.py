"""Commands over an index: ask, search, urgence, info, eval. Each returns the text that it prints and an exit code."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.vectors import hashed_embedding
from gristmill.operators import citations, evaluation, prompts, rules
from gristmill.sources import curated, index_store, readers, sinks
from gristmill.sources.scratch import materialised

from .engine import Engine

# Sentences of the commands that users know.
NO_MODEL = "Mode extraits seuls — aucun modèle chargé, rien n'est reformulé.\n"
NO_CHECKLIST = "Aucune checklist ne correspond à « {} ».\n\n"
SPECIES_NOTE = "Question d'identification : le système ne conclut jamais qu'une\nespèce est comestible. Vérifie les critères ci-dessus contre une\nflore, et dans le doute, abstiens-toi."
LINE = "─" * 70


def opened(spark: SparkSession, path: str, vectors: bool = True) -> Engine:
    """An engine over the index at path; a hashing index brings its own embedder."""
    index = index_store.open_index(spark, path)
    name = index.meta.get("embed_model", "")
    if vectors and name.startswith("hashing-"):
        return Engine(index, lambda q: hashed_embedding(q, int(name.removeprefix("hashing-")), "question"), name)
    return Engine(index)


def _question(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(1, text)], "qid long, question string")


def search(engine: Engine, question: str) -> tuple[str, int]:
    hits = engine.search(_question(engine.index.chunks.sparkSession, question))
    rows = hits.select("rank", "score", "methods", citations.citation().alias("mark"), "section", T.snippet(F.col("text")).alias("snippet")).orderBy("rank").collect()
    return "\n".join(f"{r['rank']:2}. {r.score:.4f} {r.methods:<18} {r.mark} {r.section or '—'}\n    {r.snippet}…" for r in rows), 0


def ask(engine: Engine, question: str, doctrine: DataFrame, system: str = "", generate=None, as_json: bool = False, excerpts: bool = False) -> tuple[str, int]:  # noqa: ANN001
    """Warnings first, then the answer with its checks or the excerpts alone, then the sources."""
    asked = _question(doctrine.sparkSession, question)
    hits = materialised(engine.search(asked))
    told = engine.ask(asked, doctrine, system, generate, hits).first()
    if as_json:
        view = sinks.json_view(["rank", "score", "methods", "source_id", "page_from", "page_to", "section", "text"])
        return "\n".join(r[0] for r in hits.orderBy("rank").select(view).collect()), 0
    if told.refused:
        return f"{told.refusal}\n\n(couverture lexicale {told.coverage or 0:.0%}, cosinus max {told.cos_max or 0:.3f}, {told.n_lexical} passages contenant un terme de la question)", 0
    out = [r.warning for r in prompts.human_warnings(rules.outdated_doctrine(asked, hits, doctrine), doctrine).collect()]
    answer = getattr(told, "answer", None)
    if answer:
        given = doctrine.sparkSession.createDataFrame([(1, answer)], "qid long, answer string")
        report = citations.report(given, hits).first()
        out += [citations.annotated(given, hits).first().answer, f"\ncitations : {report.valid}/{report.citations} valides"]
    else:
        out.append(NO_MODEL)
    out.append(f"\n{LINE}\nSOURCES")
    for r in hits.select("*", citations.citation().alias("mark"), citations.reference().alias("reference")).orderBy("rank").collect():
        out.append(f"\n{r['rank']}. {r.mark}  {r.reference}" + (f"\n   section « {r.section} »" if r.section else ""))
        out.append(f"   score {r.score:.4f} ({r.methods})" + (f"  ⚠ OCR {r.quality:.2f}" if r.quality < 0.6 else ""))
        if excerpts or not answer:
            out += [f"   │ {line}" for line in r.text.splitlines()]
    for r in rules.date_gap(hits).collect():
        out.append(f"\n  Sources publiées entre {r.oldest} et {r.newest} : vérifie les dates sur les points médicaux.")
    if told.identification:
        out.append(f"\n{LINE}\n{SPECIES_NOTE}")
    return "\n".join(out), 0


def urgence(spark: SparkSession, folder: str, subject: str) -> tuple[str, int]:
    """The best checklist as it stands; no index, no model."""
    lists = readers.checklists(spark, folder)
    if not subject:
        return prompts.checklist_summary(lists), 0
    found = rules.checklist_route(_question(spark, subject), lists).where("rank <= 4").orderBy("rank").collect()
    if not found:
        return NO_CHECKLIST.format(subject) + prompts.checklist_summary(lists), 1
    page = lists.where(F.col("name") == found[0].name).select(prompts.checklist_page(F.col("title"), F.col("body"))).first()[0]
    also = ", ".join(r.name for r in found[1:])
    return page + (f"\nVoir aussi : {also}" if also else ""), 0


def info(spark: SparkSession, path: str) -> tuple[str, int]:
    index = index_store.open_index(spark, path)
    out = [f"Index : {path}"] + [f"  {label}: {index.meta.get(key, '?')}" for label, key in (("construit le   ", "built_at"), ("modèle vecteurs", "embed_model"), ("fragments      ", "chunk_count"))]
    out.append(f"\n{'source':<28} {'licence':<16} fragments\n" + "─" * 66)
    stats = index_store.source_stats(index.sources, index.chunks).join(index.sources.select("id", "licence"), "id").orderBy("id")
    out += [f"{r.id:<28} {r.licence or '?':<16} {r.chunks:>6}" for r in stats.toLocalIterator()]
    if index.meta.get("embed_model", "").startswith("hashing-"):
        out.append("\n⚠ Index de TEST (backend hashing) : recherche purement lexicale.")
    return "\n".join(out), 0


def evaluate(engine: Engine, cases: DataFrame, doctrine: DataFrame, checklists: DataFrame, system: str = "", generate=None) -> tuple[str, int]:  # noqa: ANN001
    """The report by kind; exit code 1 if a failure blocks."""
    failed, summary, rate = engine.evaluate(cases, doctrine, checklists, system, generate)
    have = {r.kind: r for r in summary.collect()}
    out = [f"  {k:<16} {have[k].passed:3}/{have[k].cases:<3} {have[k].percent:5.1f} %" for k in evaluation.KINDS if k in have]
    if rate is not None:
        r = rate.first()
        out.append(f"  {'citations':<16} {r.valid:3}/{r.citations:<3} {r.percent:5.1f} %")
    if skipped := cases.count() - curated.runnable(cases, engine.semantic).count():
        out.append(f"\n  {skipped} cas non exécutés : ils exigent un modèle d'embeddings sémantique.")
    rows = failed.join(cases.select("qid", "question"), "qid").orderBy(F.desc("blocking"), "qid", "control", "detail").collect()
    out += [f"  {'‼' if r.blocking else '·'} [{r.control}] {r.question}\n      {r.detail}" for r in rows]
    return "\n".join(out), int(any(r.blocking for r in rows))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gristmill")
    parser.add_argument("--index", default="build/index")
    parser.add_argument("--doctrine")
    parser.add_argument("--checklists", default="regional/urgence")
    parser.add_argument("--no-vectors", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ask", "search"):
        commands.add_parser(name).add_argument("question")
    commands.choices["ask"].add_argument("--json", action="store_true")
    commands.choices["ask"].add_argument("--excerpts", action="store_true")
    commands.add_parser("urgence").add_argument("subject", nargs="*")
    commands.add_parser("info")
    commands.add_parser("eval").add_argument("cases")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("gristmill").getOrCreate()
    rules_of = lambda: curated.doctrine(spark, Path(a.doctrine).read_text(encoding="utf-8") if a.doctrine and Path(a.doctrine).exists() else None)
    if a.command == "urgence":
        text, code = urgence(spark, a.checklists, " ".join(a.subject))
    elif a.command == "info":
        text, code = info(spark, a.index)
    elif a.command == "search":
        text, code = search(opened(spark, a.index, not a.no_vectors), a.question)
    elif a.command == "ask":
        text, code = ask(opened(spark, a.index, not a.no_vectors), a.question, rules_of(), as_json=a.json, excerpts=a.excerpts)
    else:
        cases = curated.golden_cases(spark, Path(a.cases).read_text(encoding="utf-8"))
        text, code = evaluate(opened(spark, a.index, not a.no_vectors), cases, rules_of(), readers.checklists(spark, a.checklists))
    print(text)
    return code
