"""The retrieval engine against small models and SQLite's full-text index."""

import sqlite3
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.vectors import decode_probe, encode_probe, hashed_embedding
from gristmill.operators import chunking, citations, evaluation, fusion, lexical, rules, vector
from gristmill.plans.engine import Engine
from gristmill.sources import index_store, manifest
from gristmill.sources.index_store import IndexMismatch


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_fold_matches_decomposition(spark):
    texts = ["Ça & là", "CŒUR ﬁn ½ Straße", "plain", "", "ÅÄÖ ①ﬀ’", "été"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.fold(F.col("t")))
    model = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))
    assert rows(df, "i") == [(i, model(t)) for i, t in enumerate(texts)]


def test_terms_and_specs(spark):
    r = one(spark, "Que faire si l'eau frissonne ? Orages être à cœur", T.terms(F.col("t")).alias("x"), F.transform(T.terms(F.col("t")), T.term_spec).alias("s"))
    assert r.x == ["eau", "frissonne", "orages", "être", "ur"]
    assert [(s.kind, s.key) for s in r.s] == [("x", "eau"), ("p6", "frisso"), ("p6", "orages"), ("x", "etre"), ("x", "ur")]
    assert one(spark, "que faire ?", T.terms(F.col("t"))).asDict().popitem()[1] == ["que", "faire"]


def test_clean_quality_tokens_headings(spark):
    r = one(spark, " cou­per un mé-\nlange\t\t ici\n\n\n\nfin ", T.clean(F.col("t")).alias("c"))
    assert r.c == "couper un mélange ici\n\nfin"
    assert one(spark, "Un bon mot, x 12 (ok)", T.quality(F.col("t")).alias("q")).q == round(4 / 6, 3)
    assert one(spark, "  ", T.quality(F.col("t")).alias("q")).q == 0.0
    assert one(spark, "abcd efgh", T.token_estimate(F.col("t")).alias("n")).n == 2
    blocks = one(spark, "# Titre\n\nSignes précoces\n\nUne phrase. Finie.\n\nligne une\nligne deux\n\nCoupé par la", T.blocks(F.col("t")).alias("b")).b
    assert [(b.text, b.is_heading) for b in blocks] == [("Titre", True), ("Signes précoces", True), ("Une phrase. Finie.", False), ("ligne une ligne deux", False), ("Coupé par la", False)]


def test_html(spark):
    html = "<p>a&nbsp;b</p><script>x<y</script><style>p{}</style>&lt;c&gt;"
    assert one(spark, html, T.html_to_text(F.col("t")).alias("x")).x == "a b <c>"


def test_bm25_equals_sqlite(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["eau", "feu", "frissons", "frissonne", "abri", "orage", "orages", "sel", "trempe", "tremble", "tremblement"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 30))), " ".join(rng.choice(vocabulary, 2))) for i in range(60)]
    asked = [(i, " ".join(rng.choice(vocabulary, 3))) for i in range(12)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, s, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into f(rowid, t, s) values (?, ?, ?)", [(i + 1, t, s) for i, t, s in docs])
    chunks = spark.createDataFrame(docs, "rowid long, text string, section string")
    found = lexical.bm25(lexical.query_terms(spark.createDataFrame(asked, "qid long, question string")), lexical.postings(chunks))
    ours = {}
    for r in found.orderBy("qid", "rank").collect():
        ours.setdefault(r.qid, []).append((r.rowid, r.score))
    for qid, q in asked:
        match = " OR ".join(f'"{t}"' if len(t) < 5 else f'"{t[:6]}"*' for t in q.split())
        theirs = [(i - 1, round(-s, 9)) for i, s in db.execute("select rowid, bm25(f, 1.0, 2.0) from f where f match ?", (match,))]
        assert sorted(theirs, key=lambda x: (-x[1], x[0]))[:50] == [(i, pytest.approx(s, abs=2e-9)) for i, s in ours[qid]]


def test_bm25_asks_only_for_its_keys(spark):
    chunks = spark.createDataFrame([(1, "eau de pluie", "eau"), (2, "feu", None), (3, None, None)], "rowid long, text string, section string")
    asked = lexical.query_terms(spark.createDataFrame([(1, "eau eau")], "qid long, question string"))
    few, whole = lexical.postings(chunks, asked), lexical.postings(chunks)
    assert rows(few, "rowid", "kind") == [("", "", 1, 0.0, 4), ("x", "eau", 1, 3.0, 4), ("", "", 2, 0.0, 1), ("", "", 3, 0.0, 0)]
    assert rows(lexical.bm25(asked, few), "rank") == rows(lexical.bm25(asked, whole), "rank") and rows(lexical.document_lengths(whole), "rowid") == [(1, 4), (2, 1), (3, 0)]


def test_vector_blocks_equal_one_product(spark):
    rng = np.random.default_rng(4)
    q = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(5)]) for i in range(23)], "qid long, embedding array<double>")
    v = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(5)]) for i in range(101)], "rowid long, embedding array<double>")
    order = ("qid", "rowid")
    from pyspark.sql import Window

    top = lambda df: rows(df.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rowid"))).where("n <= 3"), *order)
    assert top(vector.scored(q, v, 3, held_queries=5, block_queries=7, block_rows=20)) == top(vector.scored(q, v, 3))


def test_vector_top_k_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "rowid long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, embedding array<float>")
    assert rows(vector.top_k(q, v, 2), "rank") == [(7, 1, 1.0, 1), (7, 2, 1.0, 2)]
    assert rows(vector.best_cosine(q, v), "qid") == [(7, 1.0)]
    assert vector.top_k(q, v.where("false"), 2).count() == 0


def test_guaranteed_seats_evict_the_last(spark):
    ranked = spark.createDataFrame([(1, i, 1.0 / i, 1 if i == 10 else (2 if i == 8 else None), None, i) for i in range(1, 11)], "qid long, rowid long, score double, lex_rank int, vec_rank int, rank int")
    assert [r.rowid for r in fusion.seated(ranked).orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6, 7, 10]


def test_coverage_counts_repeats(spark):
    terms = spark.createDataFrame([(1, 0, "a", "x", "a"), (1, 1, "a", "x", "a"), (1, 2, "b", "x", "b")], "qid long, pos int, term string, kind string, key string")
    df = spark.createDataFrame([("x", "a", 3), ("x", "b", 0)], "kind string, key string, df long")
    r = fusion.signals(terms, df, spark.createDataFrame([(10,)], "rows_in_all long")).first()
    a, b = np.log(1 + 10 / 4), np.log(11)
    assert (r.terms, r.unknown) == (["a", "a", "b"], ["b"]) and r.coverage == pytest.approx(2 * a / (2 * a + b), abs=1e-9)


def pages(spark, *texts):
    return spark.createDataFrame([("s", i, t, 1.0, f"p{i}.png") for i, t in enumerate(texts, 1)], "source_id string, page int, text string, quality double, image string")


def test_chunks_keep_every_paragraph_and_their_pages(spark):
    para = lambda k, n: " ".join(f"mot{k}x{i}" for i in range(n)) + "."
    found = chunking.chunks(pages(spark, f"# Partie\n\n{para(1, 150)}\n\n{para(2, 150)}", f"{para(3, 30)}\n\n# Deux\n\n{para(4, 200)}", "\n\n".join(" ".join(["phrase courte ici."] * 400) for _ in range(1)))).orderBy("ordinal").collect()
    text = "\n".join(c.text for c in found)
    assert all(f"mot{k}x0" in text for k in (1, 2, 3, 4)) and all(c.page_from <= c.page_to for c in found)
    assert found[0].section == "Partie" and found[0].page_from == 1 and found[0].chunk_id == "s#00001" and found[0].image == "p1.png"
    assert {c.section for c in found} == {"Partie", "Deux"} and all(c.tokens <= 800 for c in found)


def test_headings_alone_give_no_chunk_and_short_sections_merge(spark):
    assert chunking.chunks(pages(spark, "# Partie\n\n# Deux")).count() == 0
    (c,) = chunking.chunks(pages(spark, "# Partie\n\nTrois mots ici.\n\n# Deux\n\nEt la suite.")).collect()
    assert c.section == "Partie" and "Deux" in c.text and "Et la suite." in c.text


def test_identification(spark):
    yes = ["Est-ce comestible ?", "j'ai ramassé des amanites", "baie rouge ou noire ?", "Puis-je manger ça", "un cèpe"]
    no = ["cependant il pleut", "comment faire du feu", "un bel abri"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string").select(rules.is_identification(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == [True] * 5 + [False] * 3


def test_doctrine_and_date_gap(spark):
    rule = spark.createDataFrame([("a", ["garrot", "lien serré"], 2000, True), ("b", ["alcool", "boisson"], 2010, False)], "id string, subjects array<string>, pivot_year int, critical boolean")
    asked = spark.createDataFrame([(1, "Poser un GARROT ?"), (2, "froid")], "qid long, question string")
    hits = spark.createDataFrame([(2, 1, "", "un lien serre et", 1980), (2, 2, "", "boisson", 1990), (2, 3, "", "x", None)], "qid long, rank int, section string, text string, date int")
    assert rows(rules.outdated_doctrine(asked, hits, rule), "qid", "rank") == [(1, "a", True, 1), (2, "a", False, 1)]
    assert rules.date_gap(hits).count() == 0 and rows(rules.date_gap(hits, 5), "qid") == [(2, 1980, 1990)]


def test_checklists(spark):
    lists = spark.createDataFrame([("a", "Saignement", ["saigne", "perd du sang"], "presser la plaie"), ("b", "Froid", ["gelure"], "chaud")], "name string, title string, triggers array<string>, body string")
    asked = spark.createDataFrame([(1, "Il saigne, plaie"), (2, "rien")], "qid long, question string")
    assert rows(rules.checklist_route(asked, lists), "qid", "rank") == [(1, "a", 6 + 3 + 1, 1)]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "Une affirmation assez longue pour exiger une source. [Src p.2] Autre [src p. 9] [faux p.1]\nUne longue affirmation sans la moindre source, vraiment aucune.\nDans le doute, il faut toujours s'abstenir de consommer."), (2, None)], "qid long, answer string")
    hits = spark.createDataFrame([(1, "src", 1, 3), (1, "src", 2, 4)], "qid long, source_id string, page_from int, page_to int")
    assert [(p, k) for _, p, _, _, k in [tuple(r) for r in citations.judged(answers, hits).orderBy("pos").collect()]] == [(0, "ok"), (1, "page-hors-extrait"), (2, "source-inconnue")]
    r = citations.report(answers, hits).orderBy("qid").collect()
    assert (r[0].citations, r[0].valid, r[0].unsourced, r[1].citations, r[1].rate) == (3, 1, 1, 0, 0.0)
    assert "source-inconnue" in citations.annotated(answers, hits).orderBy("qid").first().answer


def test_manifest_rules(spark):
    good = {"id": "a", "titre": "A", "auteur": "X", "licence": "cc-by", "url": "http://h/x.EPUB?y", "priorite": 1}
    assert manifest.checked([good])[0]["priority"] == 1
    for bad in ({"zzz": 1}, {"url": None}, {"priorite": 4}, {"licence": "copyright"}, {"format": "zim"}):
        with pytest.raises(manifest.ManifestError):
            manifest.checked([good | bad])
    with pytest.raises(manifest.ManifestError):
        manifest.checked([good, good])
    df = manifest.load(spark, "sources:\n- {id: a, titre: A, auteur: X, licence: cc-by, url: 'http://h/x.EPUB?y'}\n- {id: b, titre: B, auteur: Y, licence: cc-by, url: 'http://h/z'}")
    assert [r.f for r in df.select(manifest.local_file().alias("f")).collect()] == ["a.epub", "b.pdf"]


def test_index_round_trip_and_checks(spark, tmp_path):
    chunks = spark.createDataFrame([("s", 1, 1, 1, "Feu", "faire un feu de bois sec", 0.0, 1, "fr"), ("s", 2, 2, 2, "Eau", "eau bouillie et eau filtrée", 1.0, 2, "fr"), ("t", 1, 1, 1, "", "une tente contre la pluie", 0.5, 3, "en")], "source_id string, ordinal int, page_from int, page_to int, section string, text string, quality double, priority int, lang string")
    sources = spark.createDataFrame([("s", "S", "A", 1999, "cc-by"), ("t", "T", None, None, "cc-by"), ("u", "U", "B", 2000, "cc-by")], "id string, title string, author string, date int, licence string")
    held = hashed_embedding(index_store.numbered(chunks), 64)
    index_store.build(held, sources, str(tmp_path / "i"), {"embed_model": "hashing-64"}, encode_probe(np.ones(4)))
    index = index_store.open_index(spark, str(tmp_path / "i"))
    assert index.meta["chunk_count"] == "3" and index.sources.count() == 2
    embed = lambda q: hashed_embedding(q, 64, "question")
    engine = Engine(index, embed, "hashing-64")
    asked = spark.createDataFrame([(1, "comment faire du feu"), (2, "xylophone quantique")], "qid long, question string")
    best = engine.search(asked).where("qid = 1 and rank = 1").first()
    assert best.rowid == 0 and best.quality == 1.0 and best.methods.startswith("texte#1")
    doctrine = spark.createDataFrame([("r", "R", ["feu"], 2005, True, "o", "n")], "id string, title string, subjects array<string>, pivot_year int, critical boolean, old string, current string")
    out = {r.qid: r for r in engine.ask(asked, doctrine, "SYS").collect()}
    assert not out[1].refused and "PÉRIMÉ" in out[1].user and out[2].refused and "xylophone" in out[2].refusal
    with pytest.raises(IndexMismatch):
        Engine(index, embed, "other")
    with pytest.raises(IndexMismatch):
        index_store.check_probe(index.meta, np.array([1, -1, 1, -1.0]))
    with pytest.raises(FileNotFoundError):
        index_store.open_index(spark, str(tmp_path / "none"))
    assert decode_probe("§") is None and decode_probe(None) is None


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, ["a", "b"], [3], None), (2, [], None, [])], "qid long, expected array<string>, pages array<int>, rules array<string>")
    hits = spark.createDataFrame([(1, "a", 2, 4)], "qid long, source_id string, page_from int, page_to int")
    assert [(r.missing, r.page_hit, r.ok) for r in evaluation.source_control(cases, hits).orderBy("qid").collect()] == [(["b"], True, False), ([], True, True)]
    found = spark.createDataFrame([(2, "x")], "qid long, rule string")
    assert rows(evaluation.doctrine_control(cases, found), "qid") == [(2, [], ["x"])]


def test_best_rows_are_those_of_the_joins_without_a_row_for_each_token(spark):
    odd = ["Ünïcode ½ Straße ŉa ĳssel İstanbul №5 ﬁn ΑΣ'Α ΟΔΟΣ été œuvre x_y a­a ª ét", None, "", "ÀÉÎõÿ Ÿ ǅ ǆ ȷ ɏ μ ÷ª º ¹²³ ¼x", "漢字 Straße", "strasse eau eau potable", "L'eau POTABLE, eau-forte; potables"]
    chunks = spark.createDataFrame([(i, t, (t or "")[:9] or None) for i, t in enumerate(odd * 7)], "rowid long, text string, section string")
    questions = spark.createDataFrame([(1, "eau potable potable"), (2, "unicode straße istanbul"), (3, "été œuvre strasse forte"), (4, "absent"), (5, None)], "qid long, question string")
    terms = lexical.query_terms(questions)
    keys = sorted({(r.kind, r.key) for r in lexical.postings(chunks).where("kind <> ''").select("kind", "key").collect()})
    rows = {r.rowid: r for r in lexical.counted_rows(chunks, {k: i for i, k in enumerate(keys)}).collect()}
    want = {(r.kind, r.key, r.rowid): (r.wtf, r.dl) for r in lexical.postings(chunks).collect()}
    assert {(*keys[i], r.rowid): (w, r.dl) for r in rows.values() for i, w in zip(r["keys"], r.wtf)} == {x: w for x, w in want.items() if x[0]}
    assert {i: r.dl for i, r in rows.items()} == {x[2]: w[1] for x, w in want.items() if not x[0]}
    found = lexical.best_rows(terms, chunks, 5)
    pairs = lambda df: sorted((r.qid, r.rank, r.rowid, r.score) for r in df.collect())
    assert pairs(found) == pairs(lexical.bm25(terms, lexical.postings(chunks, terms), 5)) == pairs(lexical.best_rows(terms, chunks, 5, held=2))
    assert "Generate" not in found._jdf.queryExecution().toString()
    assert lexical.best_rows(terms, chunks.where("false")).count() == lexical.best_rows(terms.where("false"), chunks).count() == 0
