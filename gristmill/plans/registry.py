"""The registered queries over whole tables, and their SQL twins.

A document stands for a chunk (rowid = doc_id, section = first line, priority = 1 + doc_id modulo 3),
a benchmark text for a question, the vector of the same number for its embedding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.vectors import hashed_embedding
from gristmill.operators import chunking, citations, evaluation, fusion, lexical, prompts, rules, vector
from gristmill.sources import index_store
from gristmill.sources.readers import html_table
from gristmill.sources.scratch import materialised

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("rowid"), F.col("source").alias("source_id"), "text", F.substring_index("text", "\n", 1).alias("section"), "lang", (1 + F.col("doc_id") % 3).cast("int").alias("priority"), T.quality(F.col("text")).alias("quality"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rowid"), "embedding")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumnRenamed("rowid", "qid").join(questions(spark, sf_dir).select("qid"), "qid")


# Our own fixtures: a few curated rows for each rule-based operator.
DOCTRINE = [("r1", "Premier point", ["their", "reanou"], 1990, True, "old one", "new one"), ("r2", "Second point", ["queau", "le la"], 2005, False, "old two", "new two"), ("r3", "Troisième point", ["und der", "einen", "schen"], 2015, True, "old three", "new three"), ("r4", "Quatrième point", ["thereof and", "rethe"], 2020, False, "old four", "new four")]
CHECKLISTS = [("alpha", "The waters", ["re and", "thon"], "and the of in water"), ("beta", "Le pain", ["le la", "éau"], "que les des et"), ("gamma", "Und so", ["und der", "heit"], "die der das schen"), ("delta", "Nothing here", ["zzzz"], "qqqq")]
SEEDS = [("the", 1), ("eau", 2), ("und", 1), ("que le", 2), ("ing", 1)]
EXCLUDED = ["zzz", "und der"]


def doctrine(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOCTRINE, "id string, title string, subjects array<string>, pivot_year int, critical boolean, old string, current string")


def checklists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHECKLISTS, "name string, title string, triggers array<string>, body string")


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]"


# ---- SQL pieces ----
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def FOLD(x: str) -> str:
    return f"strip_accents(lower({x}))"


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def TOKENS(x: str) -> str:
    return rf"regexp_extract_all({FOLD(x)}, '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def QUALITY(x: str) -> str:
    edge = r"[.,;:()\[\]«»\"'']+"
    good = f"regexp_full_match(regexp_replace(t, '^{edge}|{edge}$', '', 'g'), '[A-Za-zÀ-ÖØ-öø-ÿ]{{2,}}')"
    return (
        f"list_transform([list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda t: t <> '')], lambda ts: "
        f"CASE WHEN len(ts) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(ts, lambda t: {good}))::DOUBLE / len(ts), 3) END)[1]"
    )


def ESTIMATE(x: str) -> str:
    return f"greatest(1, length({x}) // 4 + (length({x}) - length(replace({x}, ' ', ''))) // 8)::INTEGER"


SECTION = "split_part(text, chr(10), 1)"
TERMS = f"""
raw_terms AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '{T.TERM_PATTERN}') AS r FROM benchmark),
kept_terms AS (SELECT qid, r, list_filter(r, lambda t: NOT list_contains({_list(T.STOPWORDS)}, {FOLD("t")})) AS k FROM raw_terms),
term_lists AS (SELECT qid, CASE WHEN len(k) > 0 THEN k ELSE r END AS ts FROM kept_terms),
term_rows AS (SELECT qid, unnest(range(len(ts)))::INTEGER AS pos, unnest(ts) AS term FROM term_lists),
terms AS (SELECT qid, pos, term, CASE WHEN length(term) < 5 THEN 'x' WHEN length(term) = 5 THEN 'p5' ELSE 'p6' END AS kind, {FOLD("left(term, 6)")} AS key FROM term_rows)"""
POSTINGS = f"""
toks AS (SELECT doc_id AS rowid, unnest({TOKENS("text")}) AS token, 1.0::DOUBLE AS w FROM documents
  UNION ALL SELECT doc_id, unnest({TOKENS(SECTION)}), 2.0::DOUBLE FROM documents),
lengths AS (SELECT doc_id AS rowid, len({TOKENS("text")}) + len({TOKENS(SECTION)}) AS dl FROM documents),
keys AS (SELECT rowid, 'x' AS kind, token AS key, w FROM toks UNION ALL SELECT rowid, 'p5', left(token, 5), w FROM toks WHERE length(token) >= 5
  UNION ALL SELECT rowid, 'p6', left(token, 6), w FROM toks WHERE length(token) >= 6),
postings AS (SELECT kind, key, rowid, sum(w) AS wtf FROM keys GROUP BY ALL)"""
DF = """
asked_keys AS (SELECT DISTINCT kind, key FROM terms),
freq AS (SELECT a.kind, a.key, count(p.rowid) AS df FROM asked_keys a LEFT JOIN postings p ON a.kind = p.kind AND a.key = p.key GROUP BY ALL)"""
BM25 = f"""
corpus AS (SELECT count(*)::DOUBLE AS n_all, avg(dl) AS avgdl FROM lengths),
asked AS (SELECT qid, kind, key, count(*) AS times FROM terms GROUP BY ALL),
idf AS (SELECT kind, key, greatest(ln((n_all - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM freq, corpus WHERE df > 0),
lex_all AS (SELECT qid, rowid, round(sum(times * idf * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * dl / avgdl))), {DIGITS}) AS score
  FROM asked JOIN idf USING (kind, key) JOIN postings USING (kind, key) JOIN lengths USING (rowid), corpus GROUP BY qid, rowid),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid)::INTEGER AS rank FROM lex_all) WHERE rank <= 50)"""
VEC = f"""
vec_all AS (SELECT q.vec_id AS qid, v.vec_id AS rowid, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), {DIGITS}) AS score
  FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid)::INTEGER AS rank FROM vec_all) WHERE rank <= 50)"""
RRF = """
fused AS (SELECT coalesce(l.qid, v.qid) AS qid, coalesce(l.rowid, v.rowid) AS rowid, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0) AS rrf, l.rank AS lex_rank, v.rank AS vec_rank
  FROM lex l FULL JOIN vec v ON l.qid = v.qid AND l.rowid = v.rowid)"""
BOOST = f"""
facts AS (SELECT doc_id AS rowid, 1 + doc_id % 3 AS priority, lang, {QUALITY("text")} AS quality FROM documents),
boosted AS (SELECT qid, f.rowid, round(rrf * CASE priority WHEN 1 THEN 1.12::DOUBLE WHEN 3 THEN 0.88::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN coalesce(nullif(lang, ''), 'fr') = 'fr' THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN quality <> 0 AND quality < 0.6 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score, lex_rank, vec_rank FROM fused f JOIN facts USING (rowid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid)::INTEGER AS rank FROM boosted)"""
SEATS = """
late AS (SELECT *, rank > 8 AND (coalesce(lex_rank, 99) <= 2 OR coalesce(vec_rank, 99) <= 2) AS late FROM ranked),
counted AS (SELECT *, count(*) FILTER (late) OVER (PARTITION BY qid) AS m, count(*) FILTER (late) OVER (PARTITION BY qid ORDER BY rank) AS nth FROM late),
kept AS (SELECT qid, rowid, score, lex_rank, vec_rank FROM counted WHERE rank <= greatest(0, 8 - m) OR (late AND nth <= 8)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid)::INTEGER AS rank FROM kept) WHERE rank <= 8)"""
SIGNALS = f"""
weighted AS (SELECT t.*, df, ln(1 + greatest((SELECT count(*) FROM documents), 1) / (1.0::DOUBLE + df)) AS w FROM terms t JOIN freq USING (kind, key)),
signals AS (SELECT qid, list(term ORDER BY pos) AS terms, coalesce(list(term ORDER BY pos) FILTER (df > 0), []) AS known, coalesce(list(term ORDER BY pos) FILTER (df = 0), []) AS unknown,
  round(CASE WHEN sum(w) > 0 THEN coalesce(sum(w) FILTER (df > 0), 0) / sum(w) ELSE 0 END, 9) AS coverage FROM weighted GROUP BY qid)"""
HITS = ",".join((TERMS, POSTINGS, DF, BM25, VEC, RRF, BOOST, SEATS))


# ---- scalar functions ----
@query(f"SELECT doc_id, {FOLD('text')} AS folded FROM documents")
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("SELECT doc_id, " + STRIP(r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g')") + " AS cleaned FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {ESTIMATE('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {QUALITY('text')} AS quality FROM documents")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.quality(F.col("text")).alias("quality"))


_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g')"
_DECODED = f"replace(replace(replace(replace(replace(replace(regexp_replace({_BARE}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"
HTML_TEXT = rf"regexp_replace(regexp_replace(regexp_replace({_DECODED}, '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')"


@query(f"SELECT page_id, {HTML_TEXT} AS text FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


_HEADING = "regexp_matches(x, " + _text(T.HEADING_PATTERN) + ") AND length(x) < 90 AND NOT contains(x, chr(10)) AND NOT regexp_matches(x, '(?i)[,;:]$|(?:^|[^\\p{L}\\p{N}_])(et|ou|de|du|des|le|la|les|un|une|à|au)$')"


@query(f"""WITH ps AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: {STRIP('x')}), lambda x: x <> '') AS ps FROM documents),
each AS (SELECT doc_id, unnest(range(len(ps)))::INTEGER AS pos, unnest(ps) AS x FROM ps)
SELECT doc_id, pos, {_HEADING} AS is_heading, CASE WHEN {_HEADING} THEN {STRIP("regexp_replace(x, '^[# ]+|[# ]+$', '', 'g')")} ELSE x END AS paragraph FROM each""")
def paragraph_blocks(spark: SparkSession, d: str) -> DataFrame:
    paged = read(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    each = paged.select("doc_id", F.posexplode(T.blocks(F.col("text"))).alias("pos", "b"))
    return each.select("doc_id", "pos", "b.is_heading", F.col("b.text").alias("paragraph"))


# ---- full text ----
@query(f"WITH {TERMS} SELECT qid, pos, term, kind, key FROM terms")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexical.query_terms(questions(spark, d))


@query(f"WITH {POSTINGS} SELECT kind, key, rowid, wtf FROM postings")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(corpus(spark, d)).where("kind <> ''").select("kind", "key", "rowid", "wtf")


@query(f"WITH {TERMS}, {POSTINGS}, {DF} SELECT kind, key, df FROM freq")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    terms = query_terms(spark, d)
    return lexical.term_frequencies(terms, lexical.postings(corpus(spark, d), terms))


@query(f"WITH {TERMS}, {POSTINGS}, {DF}, {BM25} SELECT qid, rowid, score, rank FROM lex")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.best_rows(query_terms(spark, d), corpus(spark, d), digits=DIGITS)


@query(f"WITH {TERMS}, {POSTINGS}, {DF}, {SIGNALS} SELECT qid, array_to_string(terms, ' ') AS terms, array_to_string(known, ' ') AS known, array_to_string(unknown, ' ') AS unknown, coverage, coverage < 0.2 AS refused FROM signals")
def coverage_signals(spark: SparkSession, d: str) -> DataFrame:
    terms = query_terms(spark, d)
    n = read(spark, d, "documents").agg(F.count("*").alias("rows_in_all"))
    found = fusion.signals(terms, lexical.term_frequencies(terms, lexical.postings(corpus(spark, d), terms)), n)
    return found.select("qid", *[F.array_join(c, " ").alias(c) for c in ("terms", "known", "unknown")], "coverage", fusion.refused(F.col("coverage")).alias("refused"))


# ---- vectors ----
@query(f"WITH {VEC} SELECT qid, rowid, score, rank FROM vec")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.top_k(question_vectors(spark, d), vectors(spark, d), digits=DIGITS)


@query(f"WITH {VEC} SELECT qid, max(score) AS cos_max FROM vec_all GROUP BY qid")
def vector_cos_max(spark: SparkSession, d: str) -> DataFrame:
    return vector.best_cosine(question_vectors(spark, d), vectors(spark, d), digits=DIGITS)


@query()
def hashing_embed(spark: SparkSession, d: str) -> DataFrame:
    return hashed_embedding(questions(spark, d), 256, "question").select("qid", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


# ---- fusion ----
@query(f"WITH {TERMS}, {POSTINGS}, {DF}, {BM25}, {VEC}, {RRF} SELECT qid, rowid, round(rrf, 12) AS rrf, lex_rank, vec_rank FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank(bm25_topk(spark, d), vector_topk(spark, d)).withColumn("rrf", F.round("rrf", 12))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return fusion.boosted(materialised(fusion.reciprocal_rank(bm25_topk(spark, d), vector_topk(spark, d))), corpus(spark, d))


@query(f"WITH {TERMS}, {POSTINGS}, {DF}, {BM25}, {VEC}, {RRF}, {BOOST} SELECT qid, rowid, score, lex_rank, vec_rank, rank FROM ranked")
def boosted_search(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


@query(f"WITH {HITS} SELECT qid, rowid, score, lex_rank, vec_rank, rank, concat_ws('+', 'texte#' || lex_rank, 'vect#' || vec_rank) AS methods FROM hits")
def guaranteed_seats(spark: SparkSession, d: str) -> DataFrame:
    return fusion.seated(_ranked(spark, d)).withColumn("methods", fusion.methods())


def _hits(spark: SparkSession, d: str) -> DataFrame:
    facts = corpus(spark, d).select("rowid", "source_id", "section", "text", "quality", F.concat(F.lit("T "), "source_id").alias("title"), (1980 + F.col("rowid") % 41).cast("int").alias("date"), F.col("rowid").alias("page_from"), F.col("rowid").alias("page_to"))
    return materialised(fusion.seated(_ranked(spark, d))).join(facts, "rowid")


HIT_ROWS = f"hit_rows AS (SELECT h.*, source AS source_id, {SECTION} AS section, text, {QUALITY('text')} AS quality, 'T ' || source AS title, 1980 + doc_id % 41 AS date, doc_id AS page FROM hits h JOIN documents d ON d.doc_id = h.rowid)"
_HEAD = "'[' || source_id || ' p.' || page || '] ' || title || ' (' || date || ')' || CASE WHEN section <> '' THEN ' — section « ' || section || ' »' ELSE '' END || CASE WHEN quality < 0.6 THEN '  [texte océrisé de qualité incertaine]' ELSE '' END || chr(10) || text"


@query(f"WITH {HITS}, {HIT_ROWS} SELECT qid, string_agg({_HEAD}, E'\\n\\n---\\n\\n' ORDER BY rank) AS excerpts FROM hit_rows GROUP BY qid")
def excerpt_blocks(spark: SparkSession, d: str) -> DataFrame:
    return prompts.excerpts(_hits(spark, d))


# ---- relations between tables ----
@query("SELECT source AS source_id, count(*) AS chunks FROM documents GROUP BY source")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("chunks"))


@query("SELECT n_nationkey AS id, n_name AS title, count(s_suppkey) AS chunks FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def source_stats(spark: SparkSession, d: str) -> DataFrame:
    sources = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    return index_store.source_stats(sources, read(spark, d, "supplier").select(F.col("s_nationkey").alias("source_id")))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def used_sources(spark: SparkSession, d: str) -> DataFrame:
    customers, orders = read(spark, d, "customer").select(F.col("c_custkey").alias("id")), read(spark, d, "orders").select(F.col("o_custkey").alias("source_id"))
    return index_store.used_sources(customers, orders).withColumnRenamed("id", "c_custkey")


@query(f"WITH {HITS} SELECT DISTINCT d.doc_id AS rowid, d.source AS source_id, '[' || d.source || ' p.' || d.doc_id || ']' AS citation, CASE WHEN q <> 0 THEN q ELSE 1.0 END AS quality FROM (SELECT *, {QUALITY('text')} AS q FROM documents) d WHERE doc_id IN (SELECT rowid FROM hits)")
def passages_lookup(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus(spark, d)
    sources = chunks.select(F.col("source_id").alias("id"), F.col("source_id").alias("title"), F.lit("").alias("author"), F.lit(None).cast("int").alias("date"), F.lit("cc-by").alias("licence")).distinct()
    rows = index_store.passages(chunks, sources, materialised(guaranteed_seats(spark, d))).withColumn("page_from", F.col("rowid"))
    return rows.select("rowid", "source_id", citations.citation().alias("citation"), "quality")


# ---- chunks ----
@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    pages = docs.select(F.col("doc_id").cast("string").alias("source_id"), F.lit(1).alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), T.quality(F.col("text")).alias("quality"), F.lit(None).cast("string").alias("image"))
    return chunking.chunks(pages)


@query(f"WITH t AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS source_id, {HTML_TEXT} AS text FROM pages), q AS (SELECT source_id, {QUALITY('text')} AS quality FROM t WHERE text <> '') SELECT source_id, count(*) AS pages, 0::BIGINT AS ocr_pages, count(*) FILTER (quality < 0.55) AS low_pages, round(avg(quality) FILTER (quality < 0.55), 3) AS mean_low FROM q GROUP BY source_id")
def page_report(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_report(html_table(read(spark, d, "pages")))


# ---- rules ----
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({_text(i)}, {_list(s)}, {y}, {c})" for i, _, s, y, c, _, _ in DOCTRINE) + ") AS r(id, subjects, pivot_year, critical))"


_DETECTED = f"""direct AS (SELECT item_id AS qid, id, critical, true AS by_question FROM benchmark, rules WHERE len(list_filter(subjects, lambda s: contains({FOLD('text')}, {FOLD('s')}))) > 0),
said AS (SELECT qid, id, critical, list_filter(list_transform(subjects, lambda s: {FOLD('s')}), lambda s: contains({FOLD("section || ' ' || text")}, s)) AS m FROM hit_rows JOIN rules ON date < pivot_year),
some_ AS (SELECT qid, id, critical, list_distinct(flatten(list(m))) AS m FROM said GROUP BY qid, id, critical),
both_ AS (SELECT * FROM direct UNION ALL SELECT qid, id, critical, false FROM some_ WHERE len(m) >= 2 OR len(list_filter(m, lambda s: contains(s, ' '))) > 0),
one AS (SELECT qid, id, critical, max(by_question) AS by_question FROM both_ GROUP BY qid, id, critical),
o AS (SELECT qid, id AS rule, by_question, row_number() OVER (PARTITION BY qid ORDER BY by_question DESC, critical DESC, id)::INTEGER AS rank FROM one)"""


@query(f"WITH {HITS}, {HIT_ROWS}, {_RULES}, {_DETECTED} SELECT * FROM o WHERE rank <= 3")
def divergence_detect(spark: SparkSession, d: str) -> DataFrame:
    return rules.outdated_doctrine(questions(spark, d), _hits(spark, d), doctrine(spark))


@query(f"WITH {HITS}, {HIT_ROWS} SELECT qid, min(date)::INTEGER AS oldest, max(date)::INTEGER AS newest FROM hit_rows GROUP BY qid HAVING max(date) - min(date) > 15")
def date_gap(spark: SparkSession, d: str) -> DataFrame:
    return rules.date_gap(_hits(spark, d))


_LISTS = "lists AS (SELECT * FROM (VALUES " + ", ".join(f"({_text(n)}, {_text(t)}, {_list(g)}, {_text(b)})" for n, t, g, b in CHECKLISTS) + ") AS l(name, title, triggers, body))"


@query(f"""WITH {_LISTS},
asked AS (SELECT conv_id * 1000 + turn AS qid, {FOLD("text")} AS q, regexp_extract_all({FOLD("text")}, '[a-z0-9]{{3,}}') AS words FROM conversations),
scored AS (SELECT qid, name, (list_sum(list_transform(list_transform(triggers, lambda t: {FOLD("t")}), lambda t: CASE WHEN contains(q, t) THEN CASE WHEN contains(t, ' ') THEN 10 ELSE 6 END WHEN len(list_filter(words, lambda w: contains(t, w) OR contains(w, t))) > 0 THEN 2 ELSE 0 END))
  + CASE WHEN len(list_filter(words, lambda w: contains({FOLD("title")}, w))) > 0 THEN 3 ELSE 0 END + len(list_filter(list_distinct(words), lambda w: contains({FOLD("body")}, w))))::INTEGER AS score FROM asked, lists)
SELECT qid, name, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name)::INTEGER AS rank FROM scored WHERE score > 0""")
def checklist_route(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))
    return rules.checklist_route(asked, checklists(spark))


# RE2 knows ASCII word boundaries only; what stands beside a word is spelt out instead.
_SQL_IDENT = (rules.IDENTIFICATION + "|" + rules.SPECIES).replace("'", "''").replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])")


@query(f"SELECT doc_id, regexp_matches(text, '(?is){_SQL_IDENT}') AS identification FROM documents")
def identification_flag(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", rules.is_identification(F.col("text")).alias("identification"))


SYSTEM = "Réponds avec les extraits."
_FULL_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({_text(i)}, {_text(t)}, {_list(s)}, {y}, {c}, {_text(o)}, {_text(n)})" for i, t, s, y, c, o, n in DOCTRINE) + ") AS r(id, title, subjects, pivot_year, critical, old, current))"


def _sql_text(x: str) -> str:
    return _text(x).replace("\n", "' || chr(10) || '")


@query(f"""WITH {HITS}, {HIT_ROWS}, {_FULL_RULES}, {_DETECTED},
lines AS (SELECT qid, string_agg(CASE WHEN critical THEN '‼ ' ELSE '• ' END || title || {_text(prompts.CHANGED)} || pivot_year || ')' || chr(10) || '   PÉRIMÉ  : ' || old || chr(10) || '   ACTUEL  : ' || current || chr(10) || chr(10), '' ORDER BY rank) AS lines FROM o JOIN rules ON id = rule WHERE rank <= 3 GROUP BY qid),
span AS (SELECT qid, {_text(prompts.DATES[0])} || min(date) || {_text(prompts.DATES[1])} || max(date) || {_sql_text(prompts.DATES[2])} AS span FROM hit_rows GROUP BY qid HAVING max(date) - min(date) > 15),
warned AS (SELECT qid, {_sql_text(prompts.WARNING_HEAD)} || coalesce({_sql_text(prompts.WARNING_ORDER)} || lines, '') || coalesce(span, '') || {_text(prompts.WARNING_FOOT)} || chr(10) || chr(10) || '{prompts.RULE}' || chr(10) || chr(10) AS warning FROM lines FULL JOIN span USING (qid)),
blocks AS (SELECT qid, string_agg({_HEAD}, E'\\n\\n---\\n\\n' ORDER BY rank) AS excerpts FROM hit_rows GROUP BY qid)
SELECT item_id AS qid, {_text(SYSTEM)} || CASE WHEN regexp_matches(text, '(?is){_SQL_IDENT}') THEN {_sql_text(prompts.IDENTIFICATION_NOTE)} ELSE '' END AS system,
  coalesce(warning, '') || {_sql_text(prompts.EXCERPTS_HEAD)} || coalesce(excerpts, '') || chr(10) || chr(10) || '{prompts.RULE}' || chr(10) || chr(10) || {_text(prompts.QUESTION_HEAD)} || text || {_sql_text(prompts.QUESTION_FOOT)} AS user
FROM benchmark LEFT JOIN warned ON warned.qid = item_id LEFT JOIN blocks ON blocks.qid = item_id""")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    hits, asked = materialised(_hits(spark, d)), questions(spark, d)
    warnings = prompts.doctrine_warnings(rules.outdated_doctrine(asked, hits, doctrine(spark)), doctrine(spark), rules.date_gap(hits))
    return prompts.prompts(asked, prompts.excerpts(hits), SYSTEM, warnings)


_TITLES = r"titles AS (SELECT url AS path, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)"
_SEEDS = "seeds AS (SELECT * FROM (VALUES " + ", ".join(f"({_text(t)}, {w})" for t, w in SEEDS) + ") AS s(term, weight))"


@query(f"WITH {_TITLES}, {_SEEDS} SELECT path, sum(weight)::BIGINT AS weight FROM titles JOIN seeds ON contains(lower(title), term) OR contains(term, lower(title)) WHERE title <> '' AND " + " AND ".join(f"NOT contains(lower(title), {_text(x)})" for x in EXCLUDED) + " GROUP BY path")
def seed_selection(spark: SparkSession, d: str) -> DataFrame:
    articles = read(spark, d, "pages").select(F.col("url").alias("path"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    return rules.select_articles(articles, spark.createDataFrame(SEEDS, "term string, weight int"), EXCLUDED, most=2**31 - 1)


# ---- citations and evaluation ----
def _answers(spark: SparkSession, d: str) -> DataFrame:
    talk = read(spark, d, "conversations").where("role = 'assistant'")
    mark = F.concat(F.lit(" [src"), (F.col("conv_id") % 25).cast("string"), F.lit(" p."), F.col("turn").cast("string"), F.lit("] [nope p. 3] [SRC1 p.1]"))
    return talk.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat("text", mark).alias("answer"))


def _given(spark: SparkSession, d: str) -> DataFrame:
    """Every answer was given pages 0 to 2 of each source it could cite; those it doesn't cite don't matter."""
    sources = read(spark, d, "documents").select(F.lower("source").alias("source_id")).distinct()
    cited = citations.cited(_answers(spark, d)).select("qid", "source_id").distinct()
    return cited.join(sources, "source_id").select("qid", "source_id", F.lit(0).alias("page_from"), F.lit(2).alias("page_to"))


_CITED = r"""ans AS (SELECT conv_id * 1000 + turn AS qid, text || ' [src' || (conv_id % 25) || ' p.' || turn || '] [nope p. 3] [SRC1 p.1]' AS a FROM conversations WHERE role = 'assistant'),
found AS (SELECT qid, regexp_extract_all(a, '(?i)\[([a-z0-9][a-z0-9._-]*)\s+p\.\s*(\d+)\]', 1) AS s, regexp_extract_all(a, '(?i)\[([a-z0-9][a-z0-9._-]*)\s+p\.\s*(\d+)\]', 2) AS p FROM ans),
each AS (SELECT qid, unnest(range(len(s)))::INTEGER AS pos, lower(unnest(s)) AS source_id, unnest(p)::BIGINT AS page FROM found),
kinds AS (SELECT e.*, CASE WHEN source_id NOT IN (SELECT lower(source) FROM documents) THEN 'source-inconnue' WHEN page BETWEEN 0 AND 2 THEN 'ok' ELSE 'page-hors-extrait' END AS kind FROM each e)"""


@query(f"WITH {_CITED} SELECT qid, pos, source_id, page, kind FROM kinds")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    return citations.judged(_answers(spark, d), _given(spark, d))


_UNIT_SQL = r"\[[a-zA-Z0-9][a-zA-Z0-9._-]*\s+[pP]\.\s*\d+\]"


@query(rf"""WITH {_CITED},
sent AS (SELECT qid, list_transform(regexp_extract_all(a, '(?:{_UNIT_SQL}|[^.!?\n])+[.!?]*(?:\s*{_UNIT_SQL})*'), lambda x: {STRIP('x')}) AS s FROM ans),
loose AS (SELECT qid, len(list_filter(s, lambda x: length(x) >= 45 AND NOT regexp_matches(x, '^[#*-]') AND NOT (contains(lower(x), 'doute') AND contains(lower(x), 'abstenir')) AND NOT regexp_matches(x, '{_UNIT_SQL}'))) AS unsourced FROM sent),
tally AS (SELECT qid, count(*) AS citations, count(*) FILTER (kind = 'ok') AS valid, count(*) FILTER (kind = 'source-inconnue') AS unknown_sources, count(*) FILTER (kind = 'page-hors-extrait') AS outside_pages FROM kinds GROUP BY qid)
SELECT qid, coalesce(citations, 0) AS citations, coalesce(valid, 0) AS valid, coalesce(unknown_sources, 0) AS unknown_sources, coalesce(outside_pages, 0) AS outside_pages, unsourced,
  CASE WHEN citations > 0 THEN round(valid::DOUBLE / citations, 6) ELSE 0.0::DOUBLE END AS rate FROM loose LEFT JOIN tally USING (qid)""")
def citation_report(spark: SparkSession, d: str) -> DataFrame:
    return citations.report(_answers(spark, d), _given(spark, d))


@query(f"WITH {_CITED}, o AS (SELECT qid, CASE WHEN qid % 1000 < 2 THEN 'first' ELSE 'later' END AS kind_, bool_and(kind = 'ok' OR source_id = 'nope') AS ok FROM kinds GROUP BY qid) SELECT kind_ AS kind, count(*) AS cases, count(*) FILTER (ok) AS passed, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 1) AS percent FROM o GROUP BY kind_")
def golden_eval(spark: SparkSession, d: str) -> DataFrame:
    outcome = citation_check(spark, d).groupBy("qid").agg(F.bool_and((F.col("kind") == "ok") | (F.col("source_id") == "nope")).alias("ok"))
    return evaluation.by_kind(outcome.select("qid", F.when(F.col("qid") % 1000 < 2, "first").otherwise("later").alias("kind"), "ok"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of every benchmark question by full text, vectors, fusion, editorial weight and seats."""
    return guaranteed_seats(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
