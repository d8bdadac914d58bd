"""Questions in, answers out: the whole retrieval plan over a table of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import citations, evaluation, fusion, lexical, prompts, rules, vector
from gristmill.sources import curated
from gristmill.sources.index_store import Index, check_embedder, check_probe, passages
from gristmill.sources.scratch import materialised

#: Adds an embedding to (qid, question) rows.
Embed = Callable[[DataFrame], DataFrame]

class Engine:
    """Searches an index for any number of questions at once. questions: (qid long, question string)."""

    def __init__(self, index: Index, embed: Embed | None = None, embedder: str = "", backend: str = "", probe=None, candidates: int = 50, k: int = fusion.KEPT, seats: int = fusion.SEATS):  # noqa: ANN001
        if embed is not None:
            check_embedder(index.meta, embedder, backend)
            if probe is not None:
                check_probe(index.meta, probe)
        self.index, self.embed, self.semantic = index, embed, embed is not None and not embedder.startswith("hashing-")
        self.candidates, self.k, self.seats = candidates, k, seats

    def search(self, questions: DataFrame) -> DataFrame:
        """(qid, rank, rowid, score, methods and passage columns) of the k passages of each question."""
        terms = lexical.query_terms(questions)
        lex = lexical.bm25(terms, self.index.postings, self.candidates)
        vec = vector.top_k(self.embed(questions), self.index.chunks, self.candidates) if self.embed else lex.where("false")
        ranked = fusion.boosted(fusion.reciprocal_rank(lex, vec), self.index.chunks)
        hits = fusion.seated(ranked, self.k, self.seats).withColumn("methods", fusion.methods())
        return hits.join(passages(self.index.chunks, self.index.sources, hits), "rowid")

    def signals(self, questions: DataFrame) -> DataFrame:
        terms = lexical.query_terms(questions)
        n = lexical.document_lengths(self.index.postings).agg(F.count("*").alias("rows_in_all"))
        found = questions.select("qid").join(fusion.signals(terms, lexical.term_frequencies(terms, self.index.postings), n), "qid", "left")
        best = vector.best_cosine(self.embed(questions), self.index.chunks) if self.embed else found.select("qid", F.lit(None).cast("double").alias("cos_max"))
        lists = lexical.bm25(terms, self.index.postings, self.candidates).groupBy("qid").agg(F.count("*").alias("n_lexical"))
        return found.join(best, "qid", "left").join(lists, "qid", "left").withColumn("n_lexical", F.coalesce("n_lexical", F.lit(0)))

    def ask(self, questions: DataFrame, doctrine: DataFrame, system: str, generate: Embed | None = None, hits: DataFrame | None = None) -> DataFrame:
        """(qid, refused, refusal, identification, system, user[, answer]). Refused questions don't reach ``generate``."""
        hits = materialised(self.search(questions)) if hits is None else hits
        found = rules.outdated_doctrine(questions, hits, doctrine)
        warnings = prompts.doctrine_warnings(found, doctrine, rules.date_gap(hits))
        built = prompts.prompts(questions, prompts.excerpts(hits), system, warnings)
        signals = materialised(self.signals(questions))
        no_hits = F.col("n_hits").isNull()
        refuse = fusion.refused(F.col("coverage"), F.col("cos_max"), self.semantic) | no_hits
        rows = questions.join(signals, "qid", "left").join(hits.groupBy("qid").agg(F.count("*").alias("n_hits")), "qid", "left").join(built, "qid", "left")
        out = rows.select("qid", "question", "coverage", "cos_max", "n_lexical", refuse.alias("refused"), F.when(refuse, prompts.refusal(prompts.REFUSAL, F.col("unknown"), F.col("coverage"))).alias("refusal"), rules.is_identification(F.col("question")).alias("identification"), "system", "user")
        if generate is None:
            return out
        return out.join(generate(out.where("not refused")).select("qid", "answer"), "qid", "left")

    def evaluate(self, cases: DataFrame, doctrine: DataFrame, checklists: DataFrame, system: str = "", generate: Embed | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(failures, summary by kind, citation rate) of the golden cases that this engine can run."""
        run = curated.runnable(cases, self.semantic)
        questions = run.where("kind <> 'urgence'").select("qid", "question")
        hits = materialised(self.search(questions))
        asked = materialised(self.ask(questions, doctrine, system, generate, hits))
        answers = asked.where("answer is not null").select("qid", "answer") if generate else None
        routed = rules.checklist_route(run.where("kind = 'urgence'").select("qid", "question"), checklists)
        failed = materialised(evaluation.failures(run, asked, hits, prompts.excerpts(hits), rules.outdated_doctrine(questions, hits, doctrine), routed, answers))
        return failed, evaluation.summary(run, failed), evaluation.citation_rate(citations.report(answers, hits)) if answers is not None else None
