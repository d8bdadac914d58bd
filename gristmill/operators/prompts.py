"""Excerpt blocks, warnings, prompts and refusals as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.sources.scratch import small

# Formats and sentences that a reader of the answers, or the model, relies on.
RULE, SEPARATOR = "=" * 60, "\n\n---\n\n"
IDENTIFICATION_NOTE = "\nATTENTION : cette question porte sur une identification. La règle de sûreté ci-dessus s'applique impérativement.\n"
EXCERPTS_HEAD, QUESTION_HEAD = "EXTRAITS DISPONIBLES\n\n", "QUESTION : "
QUESTION_FOOT = "\n\nRéponds uniquement à partir des extraits ci-dessus, en citant [identifiant p.numéro] après chaque affirmation."
WARNING_HEAD = "AVERTISSEMENT — DOCTRINES AYANT CHANGÉ\n\n"
WARNING_ORDER = (
    "Les extraits ci-dessous peuvent contenir des recommandations périmées. Sur les points suivants, tu dois suivre la doctrine"
    " ACTUELLE, et signaler explicitement que l'ancienne version est dépassée si un extrait la reproduit :\n\n"
)
DATES = ("Les extraits proviennent de sources publiées entre ", " et ", ". Mentionne la date des sources que tu cites sur les points médicaux, et signale toute divergence entre elles.\n\n")
WARNING_FOOT = "Cet avertissement fait autorité sur les extraits. Il n'a pas à être cité comme une source : c'est une consigne, pas un document."
HUMAN_HEAD = "\n⚠ DOCTRINES AYANT CHANGÉ — les extraits peuvent être périmés\n\n"
CHANGED = " (changement vers "
REFUSAL = (
    "Le corpus ne couvre pas cette question.\n\nJe ne peux pas répondre à partir des ouvrages indexés, et je ne répondrai pas\n"
    "de mémoire : en survie, une information inventée est plus dangereuse qu'une\nabsence de réponse.\n\n"
    "Reformule avec d'autres termes, ou ajoute un ouvrage sur ce sujet au corpus."
)
INDEX_HEAD, INDEX_FOOT = "CHECKLISTS D'URGENCE — servies telles quelles, sans modèle\n\n", "\n\n  survie urgence <mot>    par exemple : survie urgence saigne"
NO_CHECKLISTS = "Aucune checklist d'urgence trouvée dans regional/urgence/."


def excerpt(hit: Column) -> Column:
    """[id p.N] title (year) — section « s », a note on doubtful OCR, then the text."""
    head = F.concat(
        F.lit("["), hit["source_id"], F.lit(" p."), hit["page_from"].cast("string"), F.lit("] "), hit["title"],
        F.when(hit["date"].isNotNull() & (hit["date"] != 0), F.concat(F.lit(" ("), hit["date"].cast("string"), F.lit(")"))).otherwise(""),
        F.when(F.coalesce(hit["section"], F.lit("")) != "", F.concat(F.lit(" — section « "), hit["section"], F.lit(" »"))).otherwise(""),
        F.when(hit["quality"] < 0.6, "  [texte océrisé de qualité incertaine]").otherwise(""))
    return F.concat(head, F.lit("\n"), hit["text"])


def excerpts(hits: DataFrame) -> DataFrame:
    """(qid, excerpts): the blocks of each question's hits in rank order. hits has few rows for each question."""
    row = F.struct("rank", "source_id", "page_from", "title", "date", "section", "quality", "text")
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), excerpt), SEPARATOR).alias("excerpts"))


def prompts(questions: DataFrame, blocks: DataFrame, system: str, warnings: DataFrame | None = None) -> DataFrame:
    """(qid, system, user): system text with the safety note for identification questions; warnings stand before the excerpts."""
    from .rules import is_identification

    rows = questions.join(blocks, "qid", "left")
    rows = rows.join(warnings, "qid", "left") if warnings is not None else rows.withColumn("warning", F.lit(""))
    head = F.when(F.coalesce("warning", F.lit("")) != "", F.concat("warning", F.lit(f"\n\n{RULE}\n\n"))).otherwise("")
    user = F.concat(head, F.lit(EXCERPTS_HEAD), F.coalesce("excerpts", F.lit("")), F.lit(f"\n\n{RULE}\n\n{QUESTION_HEAD}"), "question", F.lit(QUESTION_FOOT))
    return rows.select("qid", F.when(is_identification(F.col("question")), system + IDENTIFICATION_NOTE).otherwise(system).alias("system"), user.alias("user"))


def _listed(found: DataFrame, rules: DataFrame, line: Column, between: str) -> DataFrame:
    """(qid, lines): a line of each rule found, in order of rank."""
    each = found.join(small(rules.withColumnRenamed("id", "rule"), 10_000), "rule").select("qid", F.struct("rank", line.alias("line")).alias("x"))
    return each.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), between).alias("lines"))


def doctrine_warnings(found: DataFrame, rules: DataFrame, gaps: DataFrame) -> DataFrame:
    """(qid, warning) for the prompt: the outdated points with old and current doctrine and its source, and the span of source dates."""
    source = T.flatten(F.coalesce("source", F.lit(""))) if "source" in rules.columns else F.lit("")
    line = F.concat(F.when(F.col("critical"), "‼ ").otherwise("• "), "title", F.lit(CHANGED), F.col("pivot_year").cast("string"), F.lit(")\n   PÉRIMÉ  : "), T.flatten(F.col("old")), F.lit("\n   ACTUEL  : "), T.flatten(F.col("current")),
                    F.when(source != "", F.concat(F.lit("\n   source  : "), source)).otherwise(""), F.lit("\n\n"))
    span = gaps.select("qid", F.concat(F.lit(DATES[0]), F.col("oldest").cast("string"), F.lit(DATES[1]), F.col("newest").cast("string"), F.lit(DATES[2])).alias("span"))
    both = _listed(found, rules, line, "").join(span, "qid", "full_outer")
    return both.select("qid", F.concat(F.lit(WARNING_HEAD), F.coalesce(F.concat(F.lit(WARNING_ORDER), "lines"), F.lit("")), F.coalesce("span", F.lit("")), F.lit(WARNING_FOOT)).alias("warning"))


def human_warnings(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(qid, warning) as a person reads it before the excerpts."""
    line = F.concat(F.when(F.col("critical"), "‼").otherwise("•"), F.lit(" "), "title", F.lit(" " + CHANGED), F.col("pivot_year").cast("string"), F.lit(")\n    Périmé : "), T.flatten(F.col("old")), F.lit("\n    Actuel : "), T.flatten(F.col("current")), F.lit("\n"))
    return _listed(found, rules, line, "\n").select("qid", F.concat(F.lit(HUMAN_HEAD), "lines").alias("warning"))


def refusal(base: str, unknown: Column, coverage: Column, most: int = 6) -> Column:
    """The refusal with the first unknown terms and the coverage in percent."""
    named = F.array_join(F.transform(F.slice(unknown, 1, most), lambda t: F.concat(F.lit("« "), t, F.lit(" »"))), ", ")
    more = F.concat(F.lit("\n\nAucun ouvrage indexé ne contient "), named, F.lit(". Couverture de la question : "), F.round(coverage * 100).cast("int").cast("string"), F.lit("%."))
    return F.concat(F.lit(base), F.when(F.size(unknown) > 0, more).otherwise(""))


def checklist_page(title: Column, body: Column, width: int = 74) -> Column:
    bar = "━" * width
    return F.concat(F.lit(f"{bar}\n  "), F.upper(title), F.lit(f"\n{bar}\n\n"), body, F.lit("\n"))


def checklist_index(checklists: DataFrame) -> DataFrame:
    """(name, line) of each checklist, the name padded to 20 (longer ones stay whole)."""
    return checklists.select("name", F.concat(F.lit("  "), F.when(F.length("name") < 20, F.rpad("name", 20, " ")).otherwise(F.col("name")), F.lit(" "), "title").alias("line")).orderBy("name")


def checklist_summary(checklists: DataFrame) -> str:
    """The list of all checklists as one text."""
    lines = [r.line for r in checklist_index(checklists).collect()]
    return INDEX_HEAD + "\n".join(lines) + INDEX_FOOT if lines else NO_CHECKLISTS
