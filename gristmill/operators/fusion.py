"""Rank fusion, editorial weight, guaranteed seats, coverage and refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RRF_K, SEATS, KEPT = 60, 2, 8


def reciprocal_rank(lexical: DataFrame, vector: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """(qid, rowid, rrf, lex_rank, vec_rank): sum of 1 / (rrf_k + rank) over both lists."""
    a = lexical.select("qid", "rowid", F.col("rank").alias("lex_rank"))
    b = vector.select("qid", "rowid", F.col("rank").alias("vec_rank"))
    part = lambda r: F.coalesce(F.lit(1.0) / (rrf_k + F.col(r)), F.lit(0.0))
    return a.join(b, ["qid", "rowid"], "full_outer").select("qid", "rowid", (part("lex_rank") + part("vec_rank")).alias("rrf"), "lex_rank", "vec_rank")


def boost() -> Column:
    """Editorial factor of a passage from priority, language and quality."""
    by_priority = F.when(F.col("priority") == 1, 1.12).when(F.col("priority") == 3, 0.88).otherwise(1.0)
    return by_priority * F.when(F.col("lang") == "fr", 1.05).otherwise(1.0) * F.when(F.col("quality") < 0.6, 0.85).otherwise(1.0)


def defaults(passages: DataFrame) -> DataFrame:
    """What a reader sees of stored values: no or zero quality is 1, no or zero priority 2, no or empty language fr."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return passages.withColumns({
        "quality": F.when(F.col("quality").isNull() | (F.col("quality") == 0), 1.0).otherwise(F.col("quality")),
        "priority": F.when(F.col("priority").isNull() | (F.col("priority") == 0), 2).otherwise(F.col("priority")),
        "lang": F.when(blank("lang") == "", "fr").otherwise(F.col("lang")), "section": blank("section"),
    })


def boosted(fused: DataFrame, passages: DataFrame, digits: int = 9) -> DataFrame:
    """Fused rows with their passage's factor, ranked; rows without a passage drop out. Ties to the smaller rowid."""
    wanted = passages.join(fused.select("rowid"), "rowid", "left_semi")
    facts = defaults(wanted).select("rowid", "priority", "lang", "quality")
    scored = fused.join(facts, "rowid").select("qid", "rowid", F.round(F.col("rrf") * boost(), digits).alias("score"), "lex_rank", "vec_rank")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rowid")))


def seated(ranked: DataFrame, k: int = KEPT, seats: int = SEATS) -> DataFrame:
    """k rows of each question, with seats for the first ``seats`` of each method.

    A guaranteed row ranked beyond k takes the place of the last of the k; one that already stands
    among those last isn't protected.
    """
    sure = (F.coalesce("lex_rank", F.lit(1 << 30)) <= seats) | (F.coalesce("vec_rank", F.lit(1 << 30)) <= seats)
    late = ranked.withColumn("late", sure & (F.col("rank") > k))
    m = late.withColumn("m", F.sum(F.col("late").cast("int")).over(Window.partitionBy("qid")))
    order = Window.partitionBy("qid").orderBy("rank")
    m = m.withColumn("nth_late", F.sum(F.col("late").cast("int")).over(order))
    kept = m.where((F.col("rank") <= F.greatest(F.lit(0), k - F.col("m"))) | (F.col("late") & (F.col("nth_late") <= k)))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rowid"))).where(F.col("rank") <= k).select("qid", "rowid", "score", "lex_rank", "vec_rank", "rank")


def methods() -> Column:
    """text#i+vect#j of a hit's ranks."""
    return F.concat_ws("+", F.when(F.col("lex_rank").isNotNull(), F.concat(F.lit("texte#"), F.col("lex_rank"))), F.when(F.col("vec_rank").isNotNull(), F.concat(F.lit("vect#"), F.col("vec_rank"))))


def signals(terms: DataFrame, frequencies: DataFrame, corpus_rows: DataFrame, digits: int = 9) -> DataFrame:
    """(qid, terms, known, unknown, coverage): share of the terms' weight ln(1 + N / (1 + df)) that the corpus knows.

    ``corpus_rows`` is one row (rows_in_all). A repeated term counts each time.
    """
    weight = F.log(1 + F.greatest(F.col("rows_in_all"), F.lit(1)) / (1 + F.col("df")))
    each = terms.join(frequencies, ["kind", "key"]).crossJoin(F.broadcast(corpus_rows)).withColumn("w", weight)
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("pos", "term")))), lambda x: x["term"])
    total, known = F.sum("w"), F.sum(F.when(F.col("df") > 0, F.col("w")).otherwise(0.0))
    return each.groupBy("qid").agg(in_order(F.lit(True)).alias("terms"), in_order(F.col("df") > 0).alias("known"), in_order(F.col("df") == 0).alias("unknown"), F.round(F.when(total > 0, known / total).otherwise(0.0), digits).alias("coverage"))


def refused(coverage: Column, cos_max: Column | None = None, semantic: bool = False, min_coverage: float = 0.20, min_cosine: float = 0.60) -> Column:
    """Whether to refuse: low coverage, and with a semantic embedder a low best cosine too."""
    low = F.coalesce(coverage, F.lit(0.0)) < min_coverage
    return low & (F.coalesce(cos_max, F.lit(-1.0)) < min_cosine) if semantic else low
