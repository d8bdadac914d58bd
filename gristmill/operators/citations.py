"""Citations of answers: extraction, verification against the passages given, and annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T

# The form of a citation, and what a reader is told of a wrong one.
CITATION = r"(?i)\[([a-z0-9][a-z0-9._-]*)\s+p\.\s*(\d+)\]"
UNKNOWN_SOURCE = ("« ", " » ne fait pas partie des extraits transmis")
OUTSIDE_PAGE = ("« ", " » a été transmis pour la ou les pages ", ", pas la page ")
NO_SOURCE = "affirmation sans citation"
PROBLEMS_HEAD = "\n⚠ VÉRIFICATION DES CITATIONS — problèmes détectés :"
PROBLEMS_FOOT = "\n  Une citation invalide signale une réponse potentiellement\n  inventée. Vérifie directement les extraits ci-dessous."
#: A citation as one unit of a sentence: its own dot ends nothing.
_UNIT = r"\[[a-zA-Z0-9][a-zA-Z0-9._-]*+\s++[pP]\.\s*+\d++\]"
#: Units and characters up to an end mark or line break, the marks, then the citations that follow.
_SENTENCE = rf"(?:{_UNIT}|[^.!?\n])++[.!?]*+(?:\s*+{_UNIT})*+"


def cited(answers: DataFrame) -> DataFrame:
    """(qid, pos, source_id, page): every citation of every answer in order, repeats kept."""
    a = F.coalesce("answer", F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(a, F.lit(CITATION), 1).alias("s"), F.regexp_extract_all(a, F.lit(CITATION), 2).alias("p"))
    return answers.select("qid", F.posexplode(both).alias("pos", "c")).select("qid", "pos", F.lower("c.s").alias("source_id"), F.col("c.p").cast("long").alias("page"))


def judged(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Citations with their kind: ok, source-inconnue or page-hors-extrait. hits: (qid, source_id, page_from, page_to).

    Page ranges are joined on the source and tested as ranges, then folded to one row for each citation.
    """
    ranges = hits.select("qid", F.lower("source_id").alias("source_id"), "page_from", "page_to").distinct()
    joined = cited(answers).join(ranges, ["qid", "source_id"], "left")
    return joined.groupBy("qid", "pos", "source_id", "page").agg(
        F.when(F.max(F.col("page").between(F.col("page_from"), F.col("page_to"))), "ok").when(F.max(F.col("page_from")).isNull(), "source-inconnue").otherwise("page-hors-extrait").alias("kind"))


def sentences(answer: Column) -> Column:
    """Sentences of an answer, each with the citations that follow it, without edge blanks."""
    return F.transform(F.regexp_extract_all(answer, F.lit(f"({_SENTENCE})"), 1), T.strip)


def unsourced(answers: DataFrame, min_chars: int = 45, cut: int = 110) -> DataFrame:
    """(qid, pos, excerpt): sentences without a citation that need one.

    Short ones, headings, list items and the formula of caution need none.
    """
    each = answers.select("qid", F.posexplode(sentences(F.coalesce("answer", F.lit("")))).alias("pos", "s"))
    low = F.lower("s")
    exempt = (F.length("s") < min_chars) | F.col("s").rlike("^[#*-]") | (F.contains(low, F.lit("doute")) & F.contains(low, F.lit("abstenir")))
    return each.where(~exempt & ~F.col("s").rlike(CITATION)).select("qid", "pos", F.substring("s", 1, cut).alias("excerpt"))


def report(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, citations, valid, unknown_sources, outside_pages, unsourced, rate) of every answer; rate 0 without citations."""
    kinds = judged(answers, hits).groupBy("qid").agg(F.count("*").alias("citations"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("ok", "valid"), ("source-inconnue", "unknown_sources"), ("page-hors-extrait", "outside_pages"))])
    loose = unsourced(answers).groupBy("qid").agg(F.count("*").alias("unsourced"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    all_ = answers.select("qid").join(kinds, "qid", "left").join(loose, "qid", "left")
    return all_.select("qid", *[zero(c) for c in ("citations", "valid", "unknown_sources", "outside_pages", "unsourced")], F.when(F.col("citations") > 0, F.round(F.col("valid") / F.col("citations"), 6)).otherwise(0.0).alias("rate"))


def problems(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, part, pos, kind, detail, excerpt): wrong citations in order, then sentences without one."""
    a = F.coalesce("answer", F.lit(""))
    marks = answers.select("qid", F.posexplode(F.regexp_extract_all(a, F.lit(f"({CITATION})"), 1)).alias("pos", "excerpt"))
    given = hits.select("qid", F.lower("source_id").alias("source_id"), F.explode(F.sequence("page_from", "page_to")).alias("p")).groupBy("qid", "source_id").agg(T.page_list(F.sort_array(F.collect_set("p"))).alias("given"))
    wrong = judged(answers, hits).where("kind <> 'ok'").join(given, ["qid", "source_id"], "left").join(marks, ["qid", "pos"])
    name = F.col("source_id")
    detail = F.when(F.col("kind") == "source-inconnue", F.concat(F.lit(UNKNOWN_SOURCE[0]), name, F.lit(UNKNOWN_SOURCE[1]))).otherwise(F.concat(F.lit(OUTSIDE_PAGE[0]), name, F.lit(OUTSIDE_PAGE[1]), "given", F.lit(OUTSIDE_PAGE[2]), F.col("page").cast("string")))
    loose = unsourced(answers).select("qid", F.lit(1).alias("part"), "pos", F.lit("phrase-sans-source").alias("kind"), F.lit(NO_SOURCE).alias("detail"), "excerpt")
    return wrong.select("qid", F.lit(0).alias("part"), "pos", "kind", detail.alias("detail"), "excerpt").unionByName(loose)


def annotated(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """answers with the problems found listed behind the text, each with where it stands."""
    line = F.concat(F.lit("  • "), "kind", F.lit(" : "), "detail", F.lit("\n    dans : "), "excerpt").alias("line")
    listed = problems(answers, hits).select("qid", F.struct("part", "pos", line).alias("x")).groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("problems"))
    told = F.concat("answer", F.lit("\n" + PROBLEMS_HEAD + "\n"), "problems", F.lit("\n" + PROBLEMS_FOOT))
    return answers.join(listed, "qid", "left").select("qid", F.when(F.col("problems").isNull(), F.col("answer")).otherwise(told).alias("answer"))


def citation(source_id: str = "source_id", page: str = "page_from") -> Column:
    return F.concat(F.lit("["), source_id, F.lit(" p."), F.col(page).cast("string"), F.lit("]"))


def reference() -> Column:
    """title — author[, year], p. N"""
    return F.concat("title", F.lit(" — "), "author", F.when(F.col("date").isNotNull() & (F.col("date") != 0), F.concat(F.lit(", "), F.col("date").cast("string"))).otherwise(""), F.lit(", p. "), F.col("page_from").cast("string"))
