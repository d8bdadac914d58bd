"""Curated lists: outdated doctrine, golden cases, archive seeds. Short YAML texts, checked on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T

DOCTRINE = "id string, title string, subjects array<string>, old string, current string, pivot_year int, critical boolean, severity string, source string"
CASES = "qid long, question string, kind string, expected array<string>, pages array<int>, mentions array<string>, lookalikes array<string>, rules array<string>, checklist string, requires string, note string"
SEEDS = "term string, weight int"
# The keys of the YAML files, and what a case or an archive has where a key is missing.
CASE_KEYS = {"q": None, "genre": "recherche", "sources_attendues": [], "pages_attendues": [], "doit_mentionner": [], "sosies_attendus": [], "divergences_attendues": None, "fiche_attendue": "", "requiert": "", "note": ""}
ARCHIVE_KEYS = {"max_articles": 25_000, "min_caracteres": 400, "max_caracteres": 60_000}


class CuratedError(ValueError):
    """A curated list breaks its form."""


def _loaded(text: str) -> dict:
    import yaml

    return yaml.safe_load(text) or {}


def doctrine(spark: SparkSession, text: str | None) -> DataFrame:
    """Rules of a YAML text with a ``divergences`` list; no text (a missing file): no rules."""
    entries = _loaded(text).get("divergences", []) if text else []
    rows = [(e["id"], e["titre"], [str(s) for s in e["sujet"]], e["ancienne"], e["actuelle"], int(e["bascule"]), e.get("gravite") == "critique", e.get("gravite", ""), e.get("source", "")) for e in entries]
    return spark.createDataFrame(rows, DOCTRINE)


def flat_doctrine(rules: DataFrame) -> DataFrame:
    """Rules as they are exported: white space of the texts flattened, a missing source empty."""
    return rules.withColumns({c: T.flatten(F.col(c)) for c in ("title", "old", "current")} | {"source": F.coalesce(T.flatten(F.col("source")), F.lit(""))})


def golden_cases(spark: SparkSession, text: str) -> DataFrame:
    """Cases of a YAML text with a ``questions`` list, numbered from 1; unknown keys and cases without a question raise."""
    rows = []
    for i, e in enumerate(_loaded(text)["questions"], 1):
        if extra := sorted(set(e) - set(CASE_KEYS)):
            raise CuratedError(f"case {i}: unknown keys {extra}")
        if "q" not in e:
            raise CuratedError(f"case {i}: no question")
        rows.append((i, *(e.get(k, default) for k, default in CASE_KEYS.items())))
    return spark.createDataFrame(rows, CASES)


def runnable(cases: DataFrame, semantic: bool) -> DataFrame:
    """Cases that can be run: those that ask for a semantic embedder are skipped without one."""
    return cases if semantic else cases.where("coalesce(requires, '') <> 'semantique'")


@dataclass(frozen=True)
class ArchiveSettings:
    """What to take from an archive. seeds: (term, weight)."""

    most: int
    min_chars: int
    max_chars: int
    namespaces: tuple[str, ...]
    exclusions: tuple[str, ...]
    seeds: tuple[tuple[str, int], ...]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([*self.seeds], SEEDS)


def archive_settings(text: str) -> ArchiveSettings:
    """Settings of a YAML text; the groups of seeds are flattened, each term with the weight of its group (1 if it has none)."""
    data = _loaded(text)
    seeds = [(term, int(group.get("poids", 1))) for group in data.get("groupes", {}).values() for term in group.get("termes", [])]
    limits = [int(data.get(k, default)) for k, default in ARCHIVE_KEYS.items()]
    return ArchiveSettings(*limits, tuple(data.get("namespaces", ["C", "A"])), tuple(data.get("exclusions", [])), tuple(seeds))


def totals(results: DataFrame) -> DataFrame:
    """(files, bytes, failed) of fetched files. results: (id, ok, size)."""
    return results.agg(F.count_if("ok").alias("files"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(~F.col("ok")).alias("failed"))
