"""What the pipeline writes for readers outside of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curated import flat_doctrine


def document_rows(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, titre, pages) with the pages of each document in order, as documents_json reads them."""
    page = F.struct(F.col("page").alias("numero"), F.col("text").alias("texte"), "ocr", F.col("quality").alias("qualite"), "image")
    held = pages.groupBy("source_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    return held.join(sources.select(F.col("id").alias("source_id"), F.col("title").alias("titre")), "source_id").select("source_id", "titre", "pages")


def write_documents(pages: DataFrame, sources: DataFrame, path: str) -> None:
    """One JSON line for each document, below source_id=...; a source that is written again replaces its own only."""
    rows = document_rows(pages, sources)
    rows.withColumn("name", F.col("source_id")).write.partitionBy("name").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def write_doctrine(rules: DataFrame, path: str) -> None:
    """Rules as JSON lines under the keys of the YAML file."""
    flat_doctrine(rules).selectExpr("id", "title titre", "subjects sujet", "old ancienne", "current actuelle", "pivot_year bascule", "severity gravite", "source").coalesce(1).write.mode("overwrite").json(path)


def lock_rows(results: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, titre, licence, url, sha256, taille) of the sources whose file was fetched and hashed. results: (id, ok, sha256, size)."""
    good = results.where("ok and coalesce(sha256, '') <> ''")
    return good.join(sources, "id").selectExpr("id", "title titre", "licence", "url", "sha256", "size taille")


def write_lock(results: DataFrame, sources: DataFrame, path: str) -> None:
    """The lock as JSON lines in the order of the ids; the list is as short as the catalogue."""
    lock_rows(results, sources).coalesce(1).sortWithinPartitions("id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_view(columns: list[str], scores: tuple[str, ...] = ("score",), digits: int = 9) -> Column:
    """A row as JSON, its scores rounded so that two engines can be compared."""
    return F.to_json(F.struct(*[F.round(c, digits).alias(c) if c in scores else F.col(c) for c in columns]))
