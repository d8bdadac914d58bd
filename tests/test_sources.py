"""Readers, sinks, curated lists, streaming: each against a small fixture."""

import hashlib
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.vectors import hashed_embedding, l2_normalised
from gristmill.operators import chunking, evaluation, rules
from gristmill.sources import curated, index_store, manifest, readers, sinks
from gristmill.streaming import ingest


def pages(df):
    return [(r.source_id, r.page, r.text) for r in df.orderBy("source_id", "page").collect()]


def test_text_and_markdown_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Un\n\nPremier  texte", encoding="utf-8")
    (tmp_path / "b.md").write_text("", encoding="utf-8")
    (tmp_path / "c.md").write_text("Troisième", encoding="utf-8")
    (tmp_path / "d.txt").write_bytes(b"abc \xff def")
    assert pages(readers.markdown_folder(spark, str(tmp_path), "r")) == [("r", 1, "# Un\n\nPremier texte"), ("r", 3, "Troisième")]
    assert readers.markdown_folder(spark, str(tmp_path), "r").first().quality == 1.0
    (only,) = pages(readers.text_files(spark, str(tmp_path / "d.txt"), "t"))
    assert only[:2] == ("t", 1) and only[2].startswith("abc ") and only[2].endswith(" def")


def book(path, chapters, package=True):
    with zipfile.ZipFile(path, "w") as z:
        for name, html in chapters:
            z.writestr(f"OPS/{name}", html)
        if package:
            z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
            items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, (n, _) in enumerate(chapters))
            z.writestr("OPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="css" href="x.css" media-type="text/css"/>{items}</manifest></package>')


def test_epub_keeps_the_order_of_the_book(spark, tmp_path):
    long = lambda k: f"<html><nav>menu</nav><body><p>{f'mot{k} ' * 80}</p><script>x()</script></body></html>"
    book(tmp_path / "one.epub", [("c1.xhtml", long(1)), ("c2.xhtml", "<p>court</p>"), ("c10.xhtml", long(10)), ("c3.xhtml", long(3))])
    book(tmp_path / "two.epub", [("b.html", long(8)), ("a.html", long(7))], package=False)
    found = pages(readers.epub_files(spark, str(tmp_path / "*.epub")))
    assert [(s, p, t.split()[0]) for s, p, t in found] == [("one", 1, "mot1"), ("one", 3, "mot10"), ("one", 4, "mot3"), ("two", 1, "mot7"), ("two", 2, "mot8")]
    assert "menu" not in found[0][2] and "x()" not in found[0][2]
    assert pages(readers.epub_files(spark, str(tmp_path / "one.epub"), "z"))[0][0] == "z"


def test_format_dispatch_and_missing_pdf_reader(spark, tmp_path):
    (tmp_path / "a.md").write_text("un texte", encoding="utf-8")
    assert pages(readers.pages_of(spark, "markdown-dir", str(tmp_path), "m")) == [("m", 1, "un texte")]
    assert pages(readers.pages_of(spark, "md", str(tmp_path / "a.md"), "m")) == [("m", 1, "un texte")]
    assert readers.pages_of(spark, "odt", str(tmp_path), "m") is None
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 nothing")
    try:
        import fitz  # noqa: F401
    except ImportError:
        assert readers.pages_of(spark, "pdf", str(tmp_path / "b.pdf"), "m").count() == 0


def test_digests_probe_lock_and_totals(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-x")
    (tmp_path / "b.bin").write_bytes(b"zz")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.file_digests(spark, str(tmp_path)).collect()}
    assert got["a.pdf"].is_pdf and not got["b.bin"].is_pdf and got["b.bin"].sha256 == hashlib.sha256(b"zz").hexdigest() and got["b.bin"].size == 2
    responses = spark.createDataFrame([("a", "http://h/a.PDF?x", b"%PDF-"), ("b", "http://h/b.pdf", b"<html"), ("c", "http://h/c", b"any"), ("d", "http://h/d", None)], "id string, url string, head binary")
    assert {r.id: r.ok for r in readers.probed(responses).collect()} == {"a": True, "b": False, "c": True, "d": False}
    sources = spark.createDataFrame([("b", "B", "cc-by", None), ("a", "A", "cc-by", "u"), ("c", "C", "cc-by", "v")], "id string, title string, licence string, url string")
    results = spark.createDataFrame([("b", True, "77", 5), ("a", True, "88", 7), ("c", False, None, None)], "id string, ok boolean, sha256 string, size long")
    sinks.write_lock(results, sources, str(tmp_path / "lock"))
    lines = [json.loads(x) for p in sorted((tmp_path / "lock").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [{"id": "a", "titre": "A", "licence": "cc-by", "url": "u", "sha256": "88", "taille": 7}, {"id": "b", "titre": "B", "licence": "cc-by", "url": None, "sha256": "77", "taille": 5}]
    assert tuple(curated.totals(results).first()) == (2, 12, 1)


def test_documents_are_written_and_read(spark, tmp_path):
    held = spark.createDataFrame([("s", 2, "deux", 0.5, False, None), ("s", 1, "un", 1.0, True, "p1.png"), ("t", 1, "x", 1.0, False, None)], readers.PAGES)
    sources = spark.createDataFrame([("s", "S"), ("t", "T")], "id string, title string")
    for _ in range(2):  # a second run replaces the first
        sinks.write_documents(held, sources, str(tmp_path / "docs"))
    assert pages(readers.documents_json(spark, str(tmp_path / "docs/*/"))) == [("s", 1, "un"), ("s", 2, "deux"), ("t", 1, "x")]


def test_chunk_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "s#00001", "source_id": "s", "ordinal": 1, "text": "un"}\n\n{"chunk_id": "s#00002", "source_id": "s", "ordinal": 2, "text": "deux"}\n', encoding="utf-8")
    assert [(r.chunk_id, r.text) for r in readers.chunk_lines(spark, str(tmp_path)).orderBy("ordinal").collect()] == [("s#00001", "un"), ("s#00002", "deux")]


DOCTRINE = """
divergences:
  - {id: b, titre: "Titre  b", sujet: [un mot, deux], ancienne: "vieux\\n  texte", actuelle: neuf, bascule: 2010, gravite: critique, source: "d'où"}
  - {id: a, titre: A, sujet: [trois], ancienne: o, actuelle: n, bascule: 1990, gravite: mineure}
"""
CASES = """
questions:
  - {q: "comment faire du feu", sources_attendues: [s], doit_mentionner: ["Feu"], divergences_attendues: []}
  - {q: "prix du pain", genre: refus}
  - {q: "bois sec et feu", sources_attendues: [t], pages_attendues: [9]}
  - {q: "il saigne", genre: urgence, fiche_attendue: sang}
  - {q: "reformulée", requiert: semantique}
"""


def test_curated_lists(spark, tmp_path):
    found = {r.id: r for r in curated.doctrine(spark, DOCTRINE).collect()}
    assert found["b"].critical and found["b"].subjects == ["un mot", "deux"] and not found["a"].critical and found["a"].source == ""
    assert curated.doctrine(spark, None).count() == 0
    sinks.write_doctrine(curated.doctrine(spark, DOCTRINE), str(tmp_path / "d"))
    out = [json.loads(x) for p in (tmp_path / "d").glob("part-*") for x in p.read_text().splitlines()]
    assert out[0] == {"id": "b", "titre": "Titre b", "sujet": ["un mot", "deux"], "ancienne": "vieux texte", "actuelle": "neuf", "bascule": 2010, "gravite": "critique", "source": "d'où"}
    cases = curated.golden_cases(spark, CASES)
    assert cases.count() == 5 and curated.runnable(cases, False).count() == 4 and curated.runnable(cases, True).count() == 5
    first = cases.orderBy("qid").first()
    assert (first.kind, first.rules, first.pages) == ("recherche", [], []) and cases.where("qid = 2").first().rules is None
    for bad in ("questions: [{q: x, zzz: 1}]", "questions: [{genre: refus}]"):
        with pytest.raises(curated.CuratedError):
            curated.golden_cases(spark, bad)
    s = curated.archive_settings("max_articles: 7\nexclusions: [Liste]\ngroupes: {a: {termes: [x, y]}, b: {poids: 2, termes: [z]}}")
    assert (s.most, s.min_chars, s.max_chars, s.namespaces, s.exclusions) == (7, 400, 60_000, ("C", "A"), ("Liste",))
    assert [tuple(r) for r in s.table(spark).collect()] == [("x", 1), ("y", 1), ("z", 2)]


def articles(spark):
    body = lambda w: f"<h1>{w}</h1><p>{(w + ' dans la forêt. ') * 40}</p>"
    rows = [("A/feu", "Le feu", "text/html", False, body("feu")), ("A/eau", "Eau potable", "text/html; charset=utf-8", False, body("eau")), ("A/liste", "Liste des feux", "text/html", False, body("feu")), ("A/court", "Feu court", "text/html", False, "<p>feu</p>"), ("A/redir", "Feu nu", "text/html", True, body("feu")), ("I/img", "Feu image", "image/png", False, ""), ("A/autre", "Musique", "text/html", False, body("violon"))]
    return spark.createDataFrame(rows, "path string, title string, mimetype string, is_redirect boolean, html string")


def test_archive_pages(spark):
    a, seeds = articles(spark), spark.createDataFrame([("feu", 1), ("eau", 2)], "term string, weight int")
    chosen = rules.select_articles(a, seeds, ["Liste"])
    assert [(r.path, r.weight) for r in chosen.collect()] == [("A/eau", 2), ("A/court", 1), ("A/feu", 1), ("A/redir", 1), ("I/img", 1)]
    found = rules.archive_pages(a, chosen, 400, 500).orderBy("page").collect()
    assert [(r.page, r.path) for r in found] == [(1, "A/eau"), (2, "A/feu")] and found[0].text.startswith("Eau potable\n\neau") and len(found[0].text) == len("Eau potable\n\n") + 500
    by_text = {r.path: r.weight for r in rules.search_articles(a, seeds).collect()}
    assert by_text["A/eau"] == 2 and by_text["A/feu"] == 1 and "A/autre" not in by_text and len(rules.search_articles(a, seeds, each=1).collect()) == 2
    assert [r.path for r in rules.search_articles(a, seeds, most=1).collect()] == ["A/eau"]


def test_available_and_private_sources(spark):
    sources = manifest.load(spark, "sources:\n- {id: a, titre: A, auteur: X, licence: cc-by, url: 'http://h/a.epub'}\n- {id: b, titre: B, auteur: Y, licence: copyright, fichier_attendu: b.pdf}\n- {id: c, titre: C, auteur: Z, licence: copyright, fichier_attendu: c.pdf}")
    files = spark.createDataFrame([("a.epub",), ("b.pdf",)], "path string")
    assert sorted(r.id for r in manifest.available(sources, files).collect()) == ["a", "b"]
    assert {r.id: r.present for r in manifest.private_report(sources, files).collect()} == {"b": True, "c": False}
    assert [r.id for r in manifest.downloadable(sources).collect()] == ["a"] and manifest.downloadable(sources, ["z"]).count() == 0
    assert manifest.suffix_of("http://h/X.PDF?y=1") == ".pdf"


def test_checklists_need_a_front_matter(spark, tmp_path):
    (tmp_path / "sang.md").write_text("---\ntitre: Saignement\ndeclencheurs: [saigne, perd du sang]\n---\n\nAppuyer.\n", encoding="utf-8")
    (tmp_path / "notes.md").write_text("sans entête", encoding="utf-8")
    (r,) = readers.checklists(spark, str(tmp_path)).collect()
    assert (r.name, r.title, r.triggers, r.body) == ("sang", "Saignement", ["saigne", "perd du sang"], "Appuyer.")


def test_page_stream_is_chunked_once(spark, tmp_path):
    held = lambda name, n: spark.createDataFrame([(name, i, f"Un paragraphe numéro {i}.", 1.0, False, None) for i in range(1, n)], readers.PAGES)
    held("s", 4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = ingest.chunk_stream(ingest.page_stream(spark, str(tmp_path / "in"), readers.PAGES), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.source_id, r.page_from, r.page_to) for r in found.collect()] == [("s", 1, 3)]
    held("t", 3).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.chunk_stream(ingest.page_stream(spark, str(tmp_path / "in"), readers.PAGES), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.source_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["s", "t"]


def test_small_functions(spark):
    one = lambda value, *c: spark.createDataFrame([(value,)], "t string").select(*c).first()
    assert one("a\nb" * 100, T.snippet(F.col("t")).alias("x")).x == ("a\nb" * 100)[:150].replace("\n", " ")
    assert one(" a \n\t b ", T.flatten(F.col("t")).alias("x")).x == "a b"
    listed = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4, 9],)], "p array<int>").select(T.page_list(F.col("p")).alias("x")).collect()
    assert [r.x for r in listed] == ["1, 2", "1–9"]
    long = " ".join(f"Phrase {i} de sept mots ici." for i in range(60))
    cut = one(long, T.sentences_packed(F.col("t"), 60).alias("x")).x
    assert " ".join(cut) == long and len(cut) > 3
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(l2_normalised(F.col("v")).alias("v")).collect()
    assert np.allclose(v[0].v, [0.6, 0.8]) and v[1].v == [0.0, 0.0]
    sections = spark.createDataFrame([("Froid", "texte"), ("", "seul"), (None, "nul")], "section string, text string").select(chunking.embedding_text().alias("x")).collect()
    assert [r.x for r in sections] == ["Froid\ntexte", "seul", "nul"]


def test_hashed_embedding_equals_a_plain_one(spark):
    texts = ["Été au bord de l'eau", "", None, "abc", "xy"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    folded = [r.f for r in df.select("i", T.fold(F.coalesce("text", F.lit(""))).alias("f")).orderBy("i").collect()]
    got = [r.embedding for r in hashed_embedding(df, 32).orderBy("i").collect()]
    for text, v in zip(folded, got):
        want = np.zeros(32)
        for n in (3, 4, 5):
            for j in range(len(text) - n + 1):
                want[int.from_bytes(hashlib.blake2b(text[j : j + n].encode(), digest_size=8).digest(), "big") % 32] += 1
        assert np.allclose(v, want / max(np.linalg.norm(want), 1e-9), atol=1e-6)


def test_reports_and_controls(spark):
    chunks = spark.createDataFrame([("s", 10), ("s", 20), ("t", 5)], "source_id string, tokens int")
    assert {r.source_id: (r.chunks, r.mean_tokens) for r in chunking.chunk_report(chunks).collect()} == {"s": (2, 15.0), "t": (1, 5.0)}
    facts = chunking.with_source_facts(chunks, spark.createDataFrame([("s", 1, "fr")], "id string, priority int, lang string")).orderBy("tokens").collect()
    assert [(r.priority, r.lang) for r in facts] == [(None, None), (1, "fr"), (1, "fr")]
    hit = lambda *x: spark.createDataFrame([(1, i, r, s) for i, (r, s) in enumerate(x, 1)], "qid long, rank int, rowid long, score double")
    differ = evaluation.parity(hit((5, 0.5), (6, 0.4), (7, 0.3)), hit((5, 0.5), (8, 0.4))).orderBy("rank").collect()
    assert [(r["rank"], r.row_a, r.row_b) for r in differ] == [(2, 6, 8), (3, 7, None)]
    triples, noise = spark.createDataFrame([(0.9, 0.1), (0.2, 0.3)], "near double, far double"), spark.createDataFrame([(0.1,), (0.3,)], "cosine double")
    r = evaluation.embedder_acceptance(triples, noise).first()
    assert (r.pairs, r.ordered) == (2, 1) and r.noise_std == pytest.approx(0.1) and r.mean_z == pytest.approx(3.5)
    routed = spark.createDataFrame([(1, "a", 9, 1), (1, "b", 8, 2), (1, "c", 7, 3), (1, "d", 6, 4), (1, "e", 5, 5)], "qid long, name string, score int, rank int")
    assert [r.name for r in evaluation.next_best(routed).orderBy("also").collect()] == ["b", "c", "d"]


def test_numbering_follows_source_and_ordinal(spark):
    chunks = spark.createDataFrame([(f"s{k:02}", o) for k in range(30) for o in range(1, 4)], "source_id string, ordinal int").repartition(5)
    got = index_store.numbered(chunks).orderBy("rowid").collect()
    assert [(r.source_id, r.ordinal) for r in got] == [(f"s{k:02}", o) for k in range(30) for o in range(1, 4)] and [r.rowid for r in got] == [*range(90)]
