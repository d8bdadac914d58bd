"""The catalogue of sources: a short YAML list, checked on the driver."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, title string, author string, date int, lang string, licence string, domains array<string>, priority int, url string, path string, expected_file string, format string, note string"
# Licences whose files may be fetched, suffixes that a URL may give a file, and the catalogue's keys.
FREE_LICENCES = ("public-domain", "libre-diffusion", "libre-acces", "licence-ouverte", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nc-sa")
SUFFIXES = (".pdf", ".epub", ".txt", ".md", ".html", ".zip")
KEYS = {"id": "id", "titre": "title", "auteur": "author", "date": "date", "langue": "lang", "licence": "licence", "domaine": "domains", "priorite": "priority", "url": "url", "chemin": "path", "fichier_attendu": "expected_file", "format": "format", "note": "note"}
REQUIRED = ("id", "titre", "auteur", "licence")


class ManifestError(ValueError):
    """The catalogue breaks one of its rules."""


def checked(entries: list[dict]) -> list[dict]:
    """Entries under our column names; raises on the first broken rule."""
    seen: set[str] = set()
    for e in entries:
        name = e.get("id", "?")
        if extra := sorted(set(e) - set(KEYS)):
            raise ManifestError(f"{name}: unknown fields {extra}")
        free = e.get("licence") in FREE_LICENCES
        for broken, why in (
            (name in seen, "duplicate id"),
            (e.get("format") == "zim" and not e.get("chemin"), "an archive needs a path"),
            (free and not (e.get("url") or e.get("chemin")), "a free source needs a url or a path"),
            (e.get("licence") == "copyright" and not e.get("fichier_attendu"), "a source under copyright needs an expected file"),
            (not 1 <= e.get("priorite", 2) <= 3, "priority must be 1, 2 or 3"),
        ):
            if broken:
                raise ManifestError(f"{name}: {why}")
        seen.add(name)
    return [{KEYS[k]: v for k, v in e.items()} | {"priority": e.get("priorite", 2)} for e in entries]


def load(spark: SparkSession, text: str) -> DataFrame:
    """The sources of a YAML text with a ``sources`` list."""
    import yaml

    raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or "sources" not in raw:
        raise ManifestError("no 'sources' key")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in checked(raw["sources"])], SCHEMA)


def is_free() -> Column:
    return F.col("licence").isin(*FREE_LICENCES)


def downloadable(sources: DataFrame, only: list[str] | None = None) -> DataFrame:
    found = sources.where(is_free() & F.col("url").isNotNull())
    return found.where(F.col("id").isin(*only)) if only else found


def local_file() -> Column:
    """Where a source's file lies: its path, else the expected file, else id and the URL's suffix (unknown ones: .pdf); archives need a path."""
    bare = F.substring_index("url", "?", 1)
    suffix = F.lower(F.regexp_extract(F.substring_index(bare, "/", -1), r"(\.[^.]+)$", 1))
    named = F.concat("id", F.when(suffix.isin(*SUFFIXES), suffix).otherwise(".pdf"))
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    return F.coalesce(blank("path"), blank("expected_file"), F.when((F.coalesce("format", F.lit("")) != "zim") & F.col("url").isNotNull(), named))


def available(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources whose file is listed. files: (path)."""
    return sources.withColumn("_file", local_file()).join(files.select(F.col("path").alias("_file")).distinct(), "_file", "left_semi").drop("_file")


def private_report(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, expected_file, present) of sources under copyright."""
    have = files.select(F.col("path").alias("expected_file")).distinct().withColumn("here", F.lit(True))
    return sources.where("licence = 'copyright'").join(have, "expected_file", "left").select("id", "expected_file", F.coalesce("here", F.lit(False)).alias("present"))


def suffix_of(name: str) -> str:
    return PurePosixPath(re.sub(r"\?.*", "", name)).suffix.lower()
