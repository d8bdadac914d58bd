"""Rule-based annotators: outdated doctrine, date gaps, identification questions, checklist routing, article selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.sources.scratch import small

# Phrasings and species stems that mark a question as one of identification.
IDENTIFICATION = (
    "comestible|mangeable|toxique|v[ée]n[ée]neux|empoisonn|"
    r"(?:peux|peut|puis)[- ]?(?:je|tu|on|il|elle)?\s*(?:le |la |les |l'|en )?(?:manger|consommer|go[ûu]ter|cueillir)|"
    r"(?:manger|consommer|cueillir)[- ](?:le|la|les|ça|ca)\b|sans danger|dangereu|risqu[ée]|"
    r"identifi|reconna[iî]tre|d[ée]termin|c'est quoi|qu'est[- ]ce que c'est|c'est bien (?:un|une|du|de la|des)|"
    r"est[- ]ce (?:bien )?(?:un|une|du|de la|des)|s'agit[- ]il|"
    r"quelle? (?:plante|esp[èe]ce|champignon|baie|fleur|feuille|fruit|arbre)|"
    r"\b(?:champignon|plante|baie|fruit|feuille|fleur|racine|graine|champignons|baies|fruits|feuilles|champ[êe]tre)\b.{0,60}\bou\b|"
    r"\bou\b.{0,40}\b(?:toxique|v[ée]n[ée]neuse?|mortelle?)\b"
)
SPECIES = (
    r"\b(?:ch[âa]taigne|marron|ail des ours|colchique|arum|cigu[ëe]|sureau|y[èe]ble|digitale|consoude|amanite|phallo[ïi]de|cortinaire|"
    r"girolle|c[èe]pe|bolet|l[ée]piote|coulemelle|russule|gal[ée]rine|omb?ellif[èe]re|carotte sauvage|panais|(?:œ|oe)nanthe|belladone|datura|"
    r"morelle|if|foug[èe]re|prunelle|cynorrhodon)(?:s|es|x)?\b"
)
# Verdicts on edibility and the formula of caution that answers are checked for.
VERDICT = (
    r"\b(?:c'est|il s'agit d'un|c'est bien un)\s+(?:un\s+|une\s+)?(?:champignon\s+)?(?:comestible|bon comestible|sans danger)"
    r"|\bvous pouvez (?:le |la |les )?(?:manger|consommer)|\btu peux (?:le |la |les )?(?:manger|consommer)|\best comestible\b|\bsans danger pour la consommation\b"
)
PRUDENCE = "dans le doute"


def is_identification(question: Column) -> Column:
    return question.rlike("(?isuU)" + IDENTIFICATION) | question.rlike("(?iuU)" + SPECIES)


def gives_verdict(answer: Column) -> Column:
    return answer.rlike("(?iuU)" + VERDICT)


def is_prudent(answer: Column) -> Column:
    return answer.rlike("(?iu)" + PRUDENCE)


def outdated_doctrine(questions: DataFrame, hits: DataFrame, rules: DataFrame, most: int = 3) -> DataFrame:
    """(qid, rule, by_question, rank): rules that a question or its excerpts touch.

    rules (id, subjects array, pivot_year, critical) is a curated list of a few rows. A question counts by any folded subject in it.
    Otherwise the excerpts dated before the pivot year count together, with a subject of several words or two different ones.
    Hits: (qid, rank, section, text, date). Order: by question first, critical first, id; at most ``most``.
    """
    few = small(rules.select("id", "pivot_year", "critical", F.transform("subjects", T.fold).alias("subjects")))
    asked = questions.select("qid", T.fold(F.coalesce("question", F.lit(""))).alias("q")).crossJoin(few)
    direct = asked.where(F.exists("subjects", lambda s: F.contains(F.col("q"), s))).select("qid", "id", "critical", F.lit(True).alias("by_question"))
    old = hits.where(F.col("date").isNotNull() & (F.col("date") != 0)).join(few, F.col("date") < F.col("pivot_year"))
    said = old.withColumn("said", T.fold(F.concat_ws(" ", "section", "text")))
    found = said.select("qid", "id", "critical", F.filter("subjects", lambda s: F.contains(F.col("said"), s)).alias("m"))
    some = found.groupBy("qid", "id", "critical").agg(F.array_distinct(F.flatten(F.collect_set("m"))).alias("m"))
    indirect = some.where((F.size("m") >= 2) | F.exists("m", lambda s: F.contains(s, F.lit(" ")))).select("qid", "id", "critical", F.lit(False).alias("by_question"))
    both = direct.unionByName(indirect).groupBy("qid", "id", "critical").agg(F.max("by_question").alias("by_question"))
    order = Window.partitionBy("qid").orderBy(F.desc("by_question"), F.desc("critical"), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("qid", F.col("id").alias("rule"), "by_question", "rank")


def date_gap(hits: DataFrame, years: int = 15) -> DataFrame:
    """(qid, oldest, newest) where the dates of the hits lie more than ``years`` apart."""
    dated = hits.where(F.col("date").isNotNull() & (F.col("date") != 0))
    return dated.groupBy("qid").agg(F.min("date").alias("oldest"), F.max("date").alias("newest")).where(F.col("newest") - F.col("oldest") > years)


def checklist_route(questions: DataFrame, checklists: DataFrame) -> DataFrame:
    """(qid, name, score, rank) of checklists with a positive score: best first, then by name.

    checklists (name, title, triggers array, body) is a curated list of a few rows. A trigger within the question scores 10 if it has several words, else 6; one
    that shares a part with a word of the question 2. A word in the title adds 3, each different word in the body 1.
    """
    few = small(checklists.select("name", T.fold(F.col("title")).alias("title"), T.fold(F.col("body")).alias("body"), F.transform("triggers", T.fold).alias("triggers")))
    asked = questions.select("qid", T.fold(F.coalesce("question", F.lit(""))).alias("q")).withColumn("words", F.regexp_extract_all("q", F.lit("([a-z0-9]{3,})"), 1))
    pairs = asked.crossJoin(few)
    one = lambda t: F.when(F.contains(F.col("q"), t), F.when(F.contains(t, F.lit(" ")), 10).otherwise(6)).when(F.exists("words", lambda w: F.contains(t, w) | F.contains(w, t)), 2).otherwise(0)
    score = F.aggregate(F.transform("triggers", one), F.lit(0), lambda a, x: a + x)
    score = score + F.when(F.exists("words", lambda w: F.contains(F.col("title"), w)), 3).otherwise(0)
    score = score + F.size(F.filter(F.array_distinct("words"), lambda w: F.contains(F.col("body"), w)))
    scored = pairs.select("qid", "name", score.cast("int").alias("score")).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "name")))


def select_articles(articles: DataFrame, seeds: DataFrame, exclusions: list[str], most: int = 25_000) -> DataFrame:
    """(path, weight): articles whose title holds a seed or is part of one, by summed weight, then path; ``most`` is the archive's limit.

    articles (path, title); seeds (term, weight) is a curated list. Titles that hold an exclusion, and empty ones, are left out.
    """
    low = F.lower("title")
    kept = articles.where(F.coalesce("title", F.lit("")) != "")
    for x in exclusions:
        kept = kept.where(~F.contains(low, F.lit(x.lower())))
    few = small(seeds.select(F.lower("term").alias("term"), "weight"))
    hit = kept.withColumn("low", low).join(few, F.contains(F.col("low"), F.col("term")) | F.contains(F.col("term"), F.col("low")))
    return hit.groupBy("path").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "path").limit(most)


def search_articles(articles: DataFrame, seeds: DataFrame, each: int = 120, most: int = 25_000) -> DataFrame:
    """(path, weight): the ``each`` best articles of every seed by full text over title and body, by summed weight, then path.

    articles (path, title, html); seeds (term, weight) is a curated list. A seed's words are one question.
    """
    from . import lexical

    held = articles.select(F.xxhash64("path").alias("rowid"), "path", F.coalesce("title", F.lit("")).alias("section"), T.html_to_text(F.coalesce("html", F.lit(""))).alias("text"))
    asked = seeds.select(F.xxhash64("term", "weight").alias("qid"), F.col("term").alias("question"), "weight")
    terms = lexical.query_terms(asked)
    best = lexical.bm25(terms, lexical.postings(held, terms), each)
    found = best.join(asked.select("qid", "weight"), "qid").groupBy("rowid").agg(F.sum("weight").alias("weight")).join(held.select("rowid", "path"), "rowid")
    return found.select("path", "weight").orderBy(F.desc("weight"), "path").limit(most)


def archive_pages(articles: DataFrame, selected: DataFrame, min_chars: int = 400, max_chars: int = 60_000) -> DataFrame:
    """(page, path, text): selected html articles in order of selection, title on top, numbered after short ones are dropped."""
    text = T.html_to_text(F.col("html"))
    rows = articles.where("mimetype like 'text/html%' and not is_redirect").join(selected, "path").withColumn("text", text).where(F.length("text") >= min_chars)
    cut = F.concat("title", F.lit("\n\n"), F.substring("text", 1, max_chars))
    # the selection is limited, so its order is one short list
    places = rows.select("path", F.row_number().over(Window.orderBy(F.desc("weight"), "path")).alias("page"))
    return rows.join(places, "path").select("page", "path", cut.alias("text"))
