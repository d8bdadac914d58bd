"""The ten operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from gristmill.llm import gru, jaccard, langid, packing, pii, quality, quotes, spm, substring, topk  # noqa: E402
from gristmill.llm.common import ASCII_LOWER, held_out  # noqa: E402

WORDS = [f"{a}{b}{c}" for a in "klmnprst" for b in "aeiou" for c in "dgnrst"]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([3, 20, 60, 200])) for _ in range(40)]
    long = prose(rng, 5000)
    near = texts[3].split() or ["x"]
    base = prose(rng, 150).split()
    copies = []
    for i in range(30):
        w = list(base)
        w[(5 * i) % 150] = f"new{i}"
        copies.append(" ".join(w))
    passage = prose(rng, 55)
    shared = [prose(rng, 30) + " " + passage + " " + prose(rng, 25 + i) for i in range(12)]
    odd = [None, "", " \n\t ", "one", "one two", "a b c", "a b c", "É\x1c ß x", "the " * 120, long, long, long + " tail", " ".join(near[:-1] + ["zz"])]
    out = [*texts, *copies, *shared, *odd, texts[0], texts[0].upper(), texts[1] + " extra"]
    return [(i, t, f"s{i % 3}", "en", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With columns whose names clash with those the operators use."""
    rows = [(*r, "x", 1, 2) for r in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, words string, node long, bucket int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1
def test_language_by_compression(spark):
    rng = random.Random(1)
    sets = {"aa": "ka ke ki ko ku".split(), "bb": "tra tre tri tro tru".split(), "cc": "öla öle öli ölo ölu".split()}
    make = lambda s: " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(60))
    rows = [(i, make(sets[lang]), lang) for i in range(150) for lang in [list(sets)[i % 3]]] + [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (903, make(sets["aa"]) * 300, None), (3, rows_text := make(sets["bb"]), "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(df, langid.fit(df, ~held_out("doc_id", 3, 1))).collect()
    got = collections.defaultdict(list)
    for r in found:
        got[r.doc_id].append(r)
    held = [r for r in rows[:150] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[i][0].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert [got[i][0].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and len(got[3]) == 2 and rows_text
    assert not got[900][0].accepted and all(0 <= r.score <= 1 for r in found)
    assert langid.predict(df.where("false"), {}).count() == 0 and langid.fit(df.where("false"), F.lit(True)) == {}
    kept = langid.accepted_rows(df, langid.fit(df, F.lit(True)))
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())


def test_many_languages_copies_and_odd_openings(spark):
    rng = random.Random(11)
    sounds = lambda k: [f"{a}{b}" for a in rng.sample("bcdfghjklmnpqrstvwxz", 5) for b in rng.sample("aeiouyäöü", 3)]
    sets = {f"l{k:03}": sounds(k) for k in range(300)}
    make = lambda s, n=30: " ".join("".join(rng.choices(s, k=rng.randint(2, 4))) for _ in range(n))
    rows = [(10 * k + i, make(s), lang) for k, (lang, s) in enumerate(sets.items()) for i in range(4)]
    copy = make(sets["l000"])
    rows += [(77, copy, "l000")] * 3000 + [(9_000 + i, "12.34 " * 2000 + make(sets["l001"], 400), "l001") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = langid.fit(df, F.lit(True))
    assert set(dictionaries) == set(sets) and all(0 < len(d) <= 131_072 for d in dictionaries.values())
    assert dictionaries["l000"].count(langid.normalised(copy)) == 1
    assert len(dictionaries["l001"]) > 5 * 400  # letters far behind the digits are read
    probe = [(k, make(sets[f"l{k:03}"], 80), None) for k in range(0, 300, 25)]
    got = langid.predict(spark.createDataFrame(probe, df.schema), dictionaries).collect()
    assert sum(r.lang_pred == f"l{r.doc_id:03}" for r in got) >= len(probe) - 1


def test_sizes_equal_a_plain_computation():
    import zstandard

    rng = random.Random(12)
    dictionaries = {"aa": prose(rng, 300).encode(), "bb": ("".join(rng.choices("xyzw ", k=4000))).encode()}
    model = langid.Classifier(dictionaries)
    for text in ("", "short", prose(rng, 2000), "Ünïcode 12 and ÉTÉ", "xyz " * 3000):
        data = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
        want = [sum(len(zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for d in dictionaries.values()]
        assert model.sizes(text) == want
        name, score, sure = model.predict(text)
        if text:
            low, high = sorted(want)
            assert name == ("aa" if want[0] <= want[1] else "bb") and score == pytest.approx((high - low) / high) and sure == (high - low >= max(2, 0.002 * high))


# 2
@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing_is_gapless_and_tight(spark, docs, corpus, capacity):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    seqs, tokens = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs, path, capacity).collect():
        seqs[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id].append(r)
    for i, text, *_ in corpus:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(tokens[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= 0.01 * sum(r[0].doc_tokens for r in tokens.values())
    assert packing.pack(docs.where("false"), path, capacity).count() == 0


def test_byte_bpe_equals_library():
    coder = packing.ByteBPE(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    parts = [*"  ab\n\t\r '1.,!éß漢😀\x00\x1c\x85\xa0　​", "'s", "<|endoftext|>", "12", "the"]
    for _ in range(3000):
        x = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert np.frombuffer(coder.encode(x), "<u4").tolist() == coder.model.encode(x, add_special_tokens=False).ids, repr(x)


def test_ids_of_whole_texts_equal_library():
    import pyarrow.parquet as pq
    from pathlib import Path

    data = Path("/root/testdata/sf0.001/documents.parquet")
    if not data.exists():
        pytest.skip("no driver tables")
    coder = packing.ByteBPE(P.path("byte_bpe_50k.json"))
    for t in pq.read_table(data, columns=["text"]).column(0).to_pylist():
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == coder.model.encode(t or "", add_special_tokens=False).ids


# 3
def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((160, 6)).astype(np.float32)
    x[20:60] = x[20]
    rows = [(i, [float(c) for c in v], "n") for i, v in enumerate(x)] + [(500, None, "n"), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0], "n"), (600, [float("nan")] * 6, "n"), (650, [float("inf")] * 6, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 10 == 0, pivots=5, block_rows=16, query_rows=4).collect()}
    v = np.floor(256 * x.astype(np.float64))
    want = {}
    for q in range(0, 160, 10):
        s = v @ v[q]
        for rank, i in enumerate(sorted((i for i in range(160) if i != q), key=lambda i: (-s[i], i))[:5], 1):
            want[q, rank] = (i, int(s[i]))
    assert found == want
    assert topk.search(df.where("false"), F.lit(True)).count() == 0 and topk.search(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_top_k_repeats_neither_queries_nor_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    rows, write = [], topk.written

    def counted(part):
        rows.append((out := write(part)).count())
        return out

    monkeypatch.setattr(topk, "written", counted)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 5 == 0, held_bytes=30_000).collect()}
    v = np.floor(256 * x.astype(np.float64))
    s = (v[::5] @ v.T).astype(int)
    want = {}
    for a in range(400):
        order = [i for i in np.lexsort((np.arange(2000), -s[a])).tolist() if i != 5 * a][:5]
        want |= {(5 * a, rank): (i, s[a, i]) for rank, i in enumerate(order, 1)}
    assert found == want
    # a query's candidates of every task are six; before, each query stood beside every annulus
    assert max(rows) <= 400 * 6 * 4 and sum(rows) < 2000 * 2 + 400 * 2 + 400 * 6 * 4


def test_top_k_of_empty_and_mixed_vectors(spark):
    rng = random.Random(31)
    rows = [(i, [rng.uniform(-1, 1) for _ in range([0, 2, 5][i % 3])]) for i in range(45)] + [(100, []), (101, None), (102, [1.0]), (6, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, b"x") for r in rows], "vec_id long, embedding array<double>, qid binary")
    got = collections.defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 6 == 0, pivots=3, block_rows=4, query_rows=2).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    v = {(i, tuple(x)): np.floor(256 * np.array(x)) for i, x in rows if x is not None}
    for q in {i for i, _ in v if i % 6 == 0 and i != 6}:
        own = next(x for (i, _), x in v.items() if i == q)
        want = sorted((-int(x @ own), i) for (i, _), x in v.items() if i != q and len(x) == len(own))[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    assert not got[102] and len(got[6]) == 5


# 4
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), place, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_spans_equal_plain_search(spark):
    rng = random.Random(3)
    parts = [*"ab1234567890..@@--+ () \n_%é😀", "4111 1111 1111 1111", "a@b.c", "192.168.0.1", "+1 (499) 555-6503", "", ""]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(1200)] + [(5000, None), (5001, "1 " * 20000 + "9" * 20000 + "a" * 20000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = by_id(pii.detect(df))
    for i, text in rows:
        assert got[i].base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest(), repr(text)
    assert pii.detect(df.where("false")).count() == 0


def test_disclosing_terms_are_found_and_taken_out(spark):
    rng = random.Random(5)
    plain_ = [(i, prose(rng, 40)) for i in range(200)]
    told = [(1000 + i, f"{prose(rng, 10)} Zorblax writes from z@home.org {prose(rng, 12)} and then zorblax again {prose(rng, i + 1)}") for i in range(6)]
    copies = [(2000 + i, "the same letter by Quinby q@home.org every time") for i in range(9)]
    df = spark.createDataFrame([(*r, "k") for r in plain_ + told + copies], "doc_id long, text string, term string")
    got = by_id(pii.detect(df))
    for i, text in told:
        spans = [s.split(":") for s in got[i].spans.split(",")]
        assert {text[int(a) : int(b)].lower() for k, a, b in spans if k == "term"} >= {"zorblax"} and got[i].n_email == 1
    assert all("term" not in got[i].spans for i, _ in plain_ + copies)
    out = by_id(pii.sanitise(df))
    assert all("zorblax" not in out[i].text.lower() and "[EMAIL]" in out[i].text and out[i].term == "k" for i, _ in told)
    assert all(out[i].text == t for i, t in plain_)


def test_terms_of_any_length_anywhere_in_the_text_disclose(spark):
    rng = random.Random(15)
    plain_ = [(i, prose(rng, 40)) for i in range(200)]
    long_ = "x" * 60
    told = [(1000 + i, f"Kim 7x42 王伟 {prose(rng, 60 + i)} write to k@home.org today {prose(rng, 50)} Lee {long_}") for i in range(4)]
    df = spark.createDataFrame(plain_ + told, "doc_id long, text string")
    got = by_id(pii.detect(df))
    for i, text in told:
        spans = [s.split(":") for s in got[i].spans.split(",")]
        terms = {text[int(a) : int(b)].lower() for k, a, b in spans if k == "term"}
        assert terms >= {"kim", "7x42", "王伟", "lee", long_} and "home" not in terms
    assert all("term" not in got[i].spans for i, _ in plain_)


def test_terms_equal_brute_force(spark):
    rng = random.Random(27)
    names = ["zor@x.org", "10.1.2.3", "quin@y.net", "+49 555 123 456"]
    rows = [(i, prose(rng, 25)) for i in range(150)]
    for k in range(60):
        pick = rng.sample(names, rng.randint(1, 2))
        rows.append((1000 + k, f"{prose(rng, 5)} term{names.index(pick[0])} {' and '.join(pick)} {prose(rng, 6)} zor word{k % 7}"))
    rows += [(2000 + k, f"term{k % 4} {prose(rng, 8)}") for k in range(10)] + [(3000, rows[160][1]), (3001, None), (3002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # plain: distinct texts, words of the text, entities with the words of their spans
    held = {}
    for text in {t or "" for _, t in rows}:
        found = {w for w in re.split(r"[^\w'-]+", text.lower()) if re.search(r"\w", w)}
        spans = [x.split(":") for x in base_spans(text).split(",") if x]
        inside, gaps, at = collections.defaultdict(set), "", 0
        for kind, a, b in spans:
            gaps += text[at : int(a)] + " "
            at = max(at, int(b))
            for w in re.split(r"[^\w'-]+", text[int(a) : int(b)].lower()):
                inside[w].add((kind, text[int(a) : int(b)].lower()))
        gaps = set(re.split(r"[^\w'-]+", (gaps + text[at:]).lower()))
        entities = {(k, text[int(a) : int(b)].lower()) for k, a, b in spans}
        held[text] = (found, entities, {w: (next(iter(inside[w])) if w not in gaps and len(inside[w]) == 1 else None) for w in found})
    n, n_e = len(held), collections.Counter(e for _, es, _ in held.values() for e in es)
    n_t, n_te = collections.Counter(w for f, _, _ in held.values() for w in f), collections.Counter()
    for f, es, alone in held.values():
        n_te.update((w, e) for w in f for e in es if alone[w] != e)
    want = {}
    for (w, e), c in n_te.items():
        if c >= 3 and n_e[e] >= 3:
            share = np.log(n * c / (n_t[w] * n_e[e])) / np.log(n / n_e[e])
            if share >= 0.8:
                want[w] = max(want.get(w, 0), share)
    for broadcast_rows in (300_000, 0):
        got = {r.term: r.share for r in pii.disclosing_terms(df, pii.written(pii.scanned(df)), broadcast_rows=broadcast_rows)[0].collect()}
        assert got.keys() == want.keys() and want and all(got[w] == pytest.approx(want[w]) for w in want)


def test_many_matches_in_one_text_take_little_time(spark):
    import time

    text = " ".join(f"user{i}@mail{i % 1000}.org said {i}" for i in range(50_000))
    df = spark.createDataFrame([(1, text), (2, "a@b.c and 1.2.3.4")], "doc_id long, text string")
    began = time.time()
    got = by_id(pii.detect(df))
    assert got[1].n_email == 50_000 and got[1].base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest()
    out = by_id(pii.sanitise(df))
    assert out[1].text == re.sub(BASE["email"], "[EMAIL]", text) and out[2].text == "[EMAIL] and [IP]"
    assert time.time() - began < 120


def test_terms_are_generalised_or_removed_by_their_share(spark):
    rng = random.Random(16)
    plain_ = [(i, prose(rng, 40)) for i in range(400)]
    told = [(1000 + i, f"{prose(rng, 20)} Zorblax and Quinby, b@home.org {prose(rng, 20 + i)}") for i in range(8)]
    # some more texts hold quinby without the entity: a share between 0.8 and 0.95
    more = [(2000 + i, f"{prose(rng, 20)} quinby {prose(rng, 20 + i)}") for i in range(4)]
    df = spark.createDataFrame(plain_ + told + more, "doc_id long, text string")
    actions = {r.term: r.action for r in pii.findings(df)[1].collect()}
    assert (actions["zorblax"], actions["quinby"]) == ("remove", "generalise")
    out = by_id(pii.sanitise(df))
    assert all("   [TERM], [EMAIL] " in out[i].text and "lax" not in out[i].text for i, _ in told)
    assert all(" [TERM] " in out[i].text for i, _ in more)


def test_terms_of_all_texts_are_not_asked_for(spark, monkeypatch):
    """A word of every text, copies or not, can't disclose an entity: its texts aren't listed."""
    rows = [f"common u{i} v{i}" + (" zork mail a@b.org" if i < 4 else "") for i in range(300)] + ["common again"] * 5
    listed, write = [], pii.written

    def seen(df):
        out = write(df)
        if out.columns == ["digest", "term"]:
            listed.extend(r.term for r in out.collect())
        return out

    monkeypatch.setattr(pii, "written", seen)
    got = by_id(pii.detect(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")))
    assert collections.Counter(listed) == {"zork": 4, "mail": 4}
    assert all(("term" in got[i].spans) == (i < 4) for i in got)


# 5
def test_language_model(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(x for _ in range(30) for x in rng.choice([("Ka", "ke", "ki"), ("to", "tu", "ta")])), "z") for i in range(120)] + [(500, None, "z"), (501, "", "z"), (502, "rare words only " * 3, "z"), (502, "rare words only " * 3, "z"), (503, "ka ke ki " * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    for head in (524_288, 4):
        got = gru.likelihoods(df, held_out("doc_id", 7, 2), hidden=8, model=4, members=2, head=head).collect()
        counts = collections.Counter(x for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2 for x in [*gru.tokens_of(t), gru.END])
        n, v = sum(counts.values()), len(counts)
        by = collections.defaultdict(list)
        for r in got:
            by[r.doc_id].append(r)
        for i, t, _ in rows:
            tokens = [*gru.tokens_of(t), gru.END]
            r = by[i][0]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[x] > 0 for x in tokens), n)
            assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)) and np.isfinite(r.score) and r.score < 0
        assert len(by[502]) == 2
        held = [r for r in got if r.held_out and r.doc_id < 120]
        assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert gru.likelihoods(df.where("false"), F.lit(True), hidden=4, model=4, members=2).count() == 0
    assert gru.likelihoods(df, F.lit(True), hidden=4, model=4, members=2).first().train_tokens == 0


def test_network_probabilities_sum_to_one():
    net = gru.Network(10, 4, 5)
    v = gru.Vocabulary([b"%d" % i for i in range(10)], np.arange(10, 0, -1), 80, 20, 10)
    h = np.random.default_rng(0).standard_normal((3, 5)).astype(np.float32)
    p = net.views(net.first(v))
    total = sum(np.exp(net.outputs(p, h, np.full(3, y))[0]) for y in range(11))
    assert np.allclose(total, 1, atol=1e-4)


def slow_score(net, flat, ids, end):
    """One document, one word, one gate at a time."""
    import math

    p = {k: v.astype(float) for k, v in net.views(flat).items()}
    n, h, x, total = net.hidden, [0.0] * net.hidden, end, 0.0
    sigmoid = lambda a: 1 / (1 + math.exp(-a))
    for y in ids:
        s = [sum(h[i] * p["u"][i, j] for i in range(n)) for j in range(3 * n)]
        z = [sigmoid(p["x"][x, j] + s[j]) for j in range(n)]
        r = [sigmoid(p["x"][x, n + j] + s[n + j]) for j in range(n)]
        c = [math.tanh(p["x"][x, 2 * n + j] + r[j] * s[2 * n + j]) for j in range(n)]
        h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(n)]
        k = net.classes if y >= net.words else y // net.members
        logits = [sum(h[i] * p["wc"][i, j] for i in range(n)) + p["bc"][j] for j in range(net.classes + 1)]
        total += logits[k] - math.log(sum(map(math.exp, logits)))
        if k < net.classes:
            logits = [sum(h[i] * p["wm"][k, i, j] for i in range(n)) + p["bm"][k, j] for j in range(net.members)]
            total += logits[y - k * net.members] - math.log(sum(map(math.exp, logits)))
        x = y
    return total


@pytest.fixture(scope="module")
def small_net():
    net = gru.Network(7, 3, 4)
    v = gru.Vocabulary([b"%d" % i for i in range(7)], np.arange(20, 13, -1), 130, 20, 7)
    flat = net.first(v) + (np.random.default_rng(3).standard_normal(net.size) * 0.3).astype(np.float32)
    return net, flat


def test_scores_equal_a_scalar_network(small_net):
    net, flat = small_net
    rng = np.random.default_rng(8)
    docs = [np.append(rng.integers(0, 8, n), 2).astype(np.int32) for n in (0, 1, 5, 40, 5, 90)]
    docs = [np.append(np.where(d[:-1] == 2, 3, d[:-1]), 2).astype(np.int32) for d in docs]
    for rows in (1, 7, 10_000):
        assert np.allclose(gru.score_documents(net, flat, docs, 2, rows), [slow_score(net, flat, d.tolist(), 2) for d in docs], rtol=1e-4)
    assert len(gru.score_documents(net, flat, [], 2)) == 0


def test_gradients_equal_finite_differences(small_net):
    net, flat = small_net
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 8, (6, 3)), rng.integers(0, 8, (6, 3))
    y[-2:, 2] = -1  # filled up: not learned
    trainer = gru.Trainer(net, flat, 2)
    h = (rng.standard_normal((3, 4)) * 0.3).astype(np.float32)
    grad, n, _ = trainer.gradient(x, y, h)
    assert n == 16

    def loss(w):
        p, state, total = net.views(w), h, 0.0
        for t in range(6):
            state = net.gates(p, x[t], state * (x[t] != 2)[:, None].astype(np.float32))[0]
            real = y[t] >= 0
            total -= net.outputs(p, state[real], y[t][real])[0].sum()
        return total

    for i in rng.choice(net.size, 120, replace=False):
        step = np.zeros(net.size, np.float32)
        step[i] = 4e-3
        assert abs((loss(flat + step) - loss(flat - step)) / 8e-3 - grad[i]) < 2e-2 * max(1, abs(grad[i]))


def test_every_training_token_is_trained_on(small_net):
    net, flat = small_net
    for n in (1, 5, 33, 1000, 1037):
        trainer = gru.Trainer(net, flat, 2, streams=16)
        trainer.fit(np.arange(n) % 7)
        assert trainer.seen == n


def test_a_window_visits_its_own_tokens_rows_and_no_others(small_net):
    net, flat = small_net
    trainer = gru.Trainer(net, flat, 2)
    net.views(trainer.square)["x"][[4, 6, 7]] = np.nan  # tokens that don't occur: a pass over all rows would spread this
    trainer.fit(np.array([0, 1, 3, 5, 2] * 20))
    was, now = net.views(flat)["x"], net.views(trainer.flat)["x"]
    assert np.isfinite(trainer.flat).all() and (was[[4, 6, 7]] == now[[4, 6, 7]]).all() and (was[[0, 1, 3, 5, 2]] != now[[0, 1, 3, 5, 2]]).any(axis=1).all()


def test_training_equals_plain_steps_on_all_parameters(small_net):
    net, flat = small_net
    ids = np.random.default_rng(4).integers(0, 8, 67)
    trainer, plain = gru.Trainer(net, flat, 2, streams=1, steps=8), gru.Trainer(net, flat, 2, streams=1, steps=8)
    trainer.fit(ids)
    h, square = np.zeros((1, 4), np.float32), np.full(net.size, 1e-6)
    for s in range(0, 67, 8):
        x, y = np.append(2, ids)[s : min(s + 8, 67)], ids[s : s + 8]
        grad, n, h = plain.gradient(x[:, None], y[:, None], h)
        grad = grad.astype(float) / n
        grad /= max(1, np.sqrt((grad**2).sum()))
        square += grad**2
        plain.flat -= (0.05 * grad / np.sqrt(square)).astype(np.float32)
    assert np.allclose(trainer.flat, plain.flat, atol=1e-4) and not np.allclose(trainer.flat, flat, atol=1e-2)


def test_classes_share_softmaxes(monkeypatch):
    net = gru.Network(600, 15, 4)
    v = gru.Vocabulary([b"%d" % i for i in range(600)], np.arange(700, 100, -1), 300_000, 900, 600)
    p = net.views(net.first(v))
    rng, calls, one = np.random.default_rng(5), [], gru.Network._softmax
    h, y = np.tanh(rng.standard_normal((2000, 4))).astype(np.float32), rng.integers(0, 601, 2000)
    parts = lambda: net.views(np.zeros(net.size, np.float32))
    ga, gb = parts(), parts()
    by_one = [net.outputs(p, h[i : i + 1], y[i : i + 1], ga) for i in range(2000)]
    monkeypatch.setattr(gru.Network, "_softmax", staticmethod(lambda *a: calls.append(1) or one(*a)))
    found, dh = net.outputs(p, h, y, gb)
    assert len(calls) == 2  # 40 classes
    assert np.allclose(found, [x[0][0] for x in by_one], atol=1e-5) and np.allclose(dh, np.concatenate([x[1] for x in by_one]), atol=1e-5)
    assert all(np.allclose(ga[k], gb[k], atol=1e-3) for k in ga) and np.abs(gb["wm"]).max() > 0.1
    cut = parts()
    assert np.allclose(net.outputs(p, h, y, cut, rows=77)[0], found, atol=1e-5) and all(np.allclose(cut[k], gb[k], atol=1e-3) for k in cut)


def test_scores_do_not_depend_on_how_many_documents_advance_together(small_net):
    net, flat = small_net
    docs = [np.append(np.arange(n) * 3 % 7, 2) for n in (0, 3, 50, 8, 3, 21)]
    assert all(np.allclose(gru.score_documents(net, flat, docs, 2, width=w), gru.score_documents(net, flat, docs, 2), rtol=1e-5) for w in (1, 2, 5))


# 6
def test_quotes_are_linked(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "On Monday, A wrote:\n> Hello  THERE.\nFine"), (1, 2, "user", "> Fine\n> > hello there.\nGood"), (1, 3, "user", "> unknown\nx"), (1, 4, "user", None), (1, 5, "user", "> How are you?\n> Good\nyes"), (2, 0, "user", "> Hello there."), (None, 1, "user", "> a"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "user", "> same\nok")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, digest int")
    got = {(r.conv_id, r.turn): (r.text, r.parent_turn, r.root_turn, r.depth) for r in quotes.link(df).collect()}
    assert got[1, 0] == (rows[0][3], None, 0, 0) and got[1, 1] == ("Fine", 0, 0, 1) and got[1, 2] == ("Good", 1, 0, 2)
    assert got[1, 3] == ("x", None, 3, 0) and got[1, 4] == (None, None, 4, 0) and got[1, 5] == ("yes", 2, 0, 3)
    assert got[2, 0][1] is None and got[3, 1] == ("ok", 0, 0, 1) and quotes.link(df).count() == len(rows)
    assert quotes.link(df.where("false")).count() == 0


def test_every_passage_is_linked_to_the_message_that_says_most_of_it(spark):
    rows = [(1, 1, "Alpha one."), (1, 2, "Beta two."), (1, 3, "Gamma three."), (1, 4, "Alpha one.\nBeta two.\nGamma three."), (1, 5, "> Alpha one.\n> Beta two.\n> Gamma three.\nall"),
            (2, 1, "Red."), (2, 2, "Blue.\nGreen."), (2, 3, "> Red.\nyes\n\n> Blue.\n> > Red.\n> Green.\nno"), (2, 4, "A wrote:\n> Red.\nB wrote:\n> Green.\nboth"),
            (3, 1, "me too"), (3, 2, "> me too\nme too"), (3, 3, "> me too\nme too"), (3, 4, "me too\n> me too")]
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    sources = lambda c, t: [(s.level, s.source_turn, s.matched) for s in got[c, t].sources]
    assert sources(1, 5) == [(1, 4, 3)] and got[1, 5].parent_turn == 4 and sources(1, 1) == []
    assert sources(2, 3) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)] and (got[2, 3].parent_turn, got[2, 3].n_linked, got[2, 3].text) == (2, 4, "yes\n\nno")
    assert sources(2, 4) == [(1, 1, 1), (1, 2, 1)] and (got[2, 4].parent_turn, got[2, 4].text) == (2, "both")
    assert [got[3, t].parent_turn for t in (2, 3, 4)] == [1, 2, 3]


def test_links_equal_brute_force(spark):
    rng = random.Random(41)
    lines = ["Alpha one.", "beta  TWO", "Gamma three!", "delta 4", "...", "epsilon"]
    mark = lambda x, n: "> " * n + x
    rows = []
    for conv in range(25):
        for turn in range(rng.randint(2, 9)):
            text = []
            for _ in range(rng.randint(1, 4)):
                level = rng.choice([0, 0, 1, 1, 2])
                text += [mark(rng.choice(lines).swapcase() if level else rng.choice(lines), level) for _ in range(rng.randint(1, 3))]
                if rng.random() < 0.3:
                    text.append("")
            rows.append((conv, turn, "user", "\n".join(text)))
    normal = lambda x: " ".join(x.lower().split())
    says = lambda x: any(c.isalnum() for c in x)
    cut = lambda x: re.match(r"((?:[ \t]*>)*)[ \t]*(.*)", x).groups()
    own, passages = {}, {}
    for conv, turn, _, text in rows:
        own[conv, turn] = {normal(x) for x in text.split("\n") if not cut(x)[0] and says(x)}
        found, block = [], 0
        held = collections.defaultdict(set)
        for x in [*text.split("\n"), ""]:
            quote, rest = cut(x)
            if quote:
                if says(x):
                    held[block, quote.count(">")].add(normal(rest))
            else:
                block += 1
        passages[conv, turn] = [(level, ls) for (_, level), ls in sorted(held.items())]
    want = {}
    for (conv, turn), quoted in passages.items():
        out = []
        for level, ls in quoted:
            votes = [(len(ls & own[conv, t]), t) for t in range(turn) if (conv, t) in own and ls & own[conv, t]]
            if votes:
                n, t = max(votes)
                out.append((level, t, n))
        want[conv, turn] = out
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for key, out in want.items():
        r = got[key]
        assert sorted((s.level, s.source_turn, s.matched) for s in r.sources) == sorted(out), (key, r)
        first = max(((n, t) for level, t, n in out if level == 1), default=None)
        assert r.parent_turn == (first[1] if first else None) and r.n_linked == sum(n for _, _, n in out)
        root, depth = key[1], 0
        while got[key[0], root].parent_turn is not None:
            root, depth = got[key[0], root].parent_turn, depth + 1
        assert (r.root_turn, r.depth) == (root, depth)


# 7
def test_sentencepiece_equals_library(spark, docs, corpus):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    parts = [*"  ab\n\t ▁éß漢😀́​\x00ﬁA.", "<s>", "<unk>", "<0x41>", "　"]
    extra = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(800)]
    both = docs.select("doc_id", "text", "words").unionByName(spark.createDataFrame([(10_000 + i, t, "w") for i, t in enumerate(extra)], "doc_id long, text string, words string"))
    got = by_id(spm.encode_decode(both, path))
    for i, t in [(r[0], r[1]) for r in corpus] + [(10_000 + i, t) for i, t in enumerate(extra)]:
        ids = [model.bos_id(), *model.encode(t or ""), model.eos_id()]
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()), repr(t)
    assert spm.encode_decode(docs.where("false"), path).count() == 0


def test_jaccard_groups_meet_once(spark, monkeypatch):
    rng = random.Random(41)
    stem = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):  # near each other, most pairs below the similarity
        words = list(stem)
        for at in rng.sample(range(120), rng.choice([1, 3, 5, 7])):
            words[at] = f"x{i}_{at}" if at % 2 else f"y{at}"
        texts.append(" ".join(words))
    met, write = [], jaccard.written

    def seen(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if "p_gid" in plan and "bit_count" in plan:
            met.append(plan)
        return write(df)

    monkeypatch.setattr(jaccard, "written", seen)
    got = by_id(jaccard.join(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 5, 80))
    sets = [set(jaccard.shingle_set(t, 5, jaccard.WordHashes()).tolist()) for t in texts]
    parent = list(range(90))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(90):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: r.component_id for i, r in got.items()} == {i: root(i) for i in range(90)}
    assert met and all("arrays_overlap" in plan for plan in met)


def test_jaccard_pairs_grow_with_members(spark, monkeypatch):
    """A group of near copies around the similarity: components as by brute force, from some pairs for each member and not from all pairs."""
    rng = random.Random(43)
    stem = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(400):
        words = list(stem)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    tested, verify = [], jaccard.verified

    def counted(pairs, sets, percent):
        tested.append(pairs.count())
        return verify(pairs, sets, percent)

    monkeypatch.setattr(jaccard, "verified", counted)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 100)
    monkeypatch.setattr(jaccard, "LIST_PAIRS", 1000)
    got = by_id(jaccard.join(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 5, 80))
    sets = [set(jaccard.shingle_set(t, 5, jaccard.WordHashes()).tolist()) for t in texts]
    label = [*range(400)]
    for i in range(400):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(label))
    assert sum(tested) < 16 * 400


# 8
@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, docs, corpus, size, percent):
    sets = {}
    for i, t, *_ in corpus:
        w = (t or "").encode().translate(ASCII_LOWER).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if x == high else x for k, x in label.items()}
        break
    got = by_id(jaccard.join(docs, size, percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), label[i]) for i in sets}
    assert jaccard.join(docs.where("false"), size, percent).count() == 0
    kept = [r.doc_id for r in jaccard.one_of_each(docs.unionByName(docs.where("doc_id < 2")), size, percent).collect()]
    assert sorted(kept) == sorted(i for i in sets if label[i] == i or not sets[i])
    # names of 3 bits: almost all sets clash and are told apart by their other bits
    if size == 4:
        again = by_id(jaccard.join(docs, size, percent, bits=3))
        assert {i: r.component_id for i, r in again.items()} == {i: r.component_id for i, r in got.items()}


def test_rows_with_one_id_are_judged_by_their_texts(spark):
    rng = random.Random(21)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(0, a), (1, a), (1, b), (2, c), (2, c), (3, c + " more"), (None, b), (None, c + " more"), (None, "alone here"), (4, ""), (4, ""), (5, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, node int")
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()), key=str)
    assert kept == sorted([(0, a), (1, b), (2, c), (None, "alone here"), (4, ""), (4, ""), (5, None)], key=str)
    assert jaccard.one_of_each(df.where("false")).count() == 0 and jaccard.one_of_each(df).columns == df.columns


def test_long_near_copies_and_a_large_group(spark):
    rng = random.Random(22)
    long = [f"{rng.choice(WORDS)}{i}" for i in range(20_000)]
    edited = lambda w, n: [x if i % (len(w) // n) else x + "q" for i, x in enumerate(w)]
    base = prose(rng, 120).split()
    group = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)], w[rng.randrange(120)] = f"new{i}", f"own{i}"
        group.append(" ".join(w))
    passage = prose(rng, 60)
    share = [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(60)]
    rows = [" ".join(long), " ".join(edited(long, 100)), " ".join(edited(long, 1000)), " ".join(edited(long, 4000)), *group, *share]
    got = by_id(jaccard.join(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")))
    table = jaccard.WordHashes()
    sets = [set(jaccard.shingle_set(t, 5, table).tolist()) for t in rows]
    label = [*range(len(rows))]
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert [got[i].component_id for i in range(len(rows))] == label and label[1] == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_samples_of_similar_sets_share_what_the_bound_says(percent):
    bounds, rng = jaccard.Bounds(percent), np.random.default_rng(5)
    for _ in range(4000):
        n = int(rng.integers(1, 90))
        both = rng.integers(0, 2**63, 2 * n + 40).astype(np.uint64)
        a = np.unique(both[:n])
        drop = int(rng.integers(0, max(1, n // 5) + 1))
        b = np.unique(np.append(a[rng.permutation(len(a))[: len(a) - drop]], both[2 * n : 2 * n + int(rng.integers(0, max(1, n // 6) + 1))]))
        if len(b) and jaccard.similar(a, b, percent):
            share = len(np.intersect1d(a[: int(bounds.sample(len(a)))], b[: int(bounds.sample(len(b)))]))
            assert share >= max(bounds.least(len(a)), bounds.least(len(b)))


# 9
def test_repeated_windows_equal_brute_force(spark, docs, corpus):
    words = {i: (t or "").encode().split() for i, t, *_ in corpus}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got, whole = by_id(substring.repeated_windows_removed(docs)), by_id(substring.repeated_windows_removed(docs, rows_too=True))
    for i, w in words.items():
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert tuple(got[i])[1:] == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        assert whole[i].text == (kept.decode() if gone else corpus[i][1]) and whole[i].source == corpus[i][2]
    assert substring.repeated_windows_removed(docs.where("false")).count() == 0
    # keys of 3 bits: most rows share theirs with others at first
    few = {i: tuple(r) for i, r in by_id(substring.repeated_windows_removed(docs, bits=3)).items()}
    assert few == {i: tuple(r) for i, r in got.items()}
    cover = substring.difference_cover(21)
    assert {(a - b) % 21 for a in cover for b in cover} == set(range(21)) and len(cover) == 5


def test_keys_are_the_same_only_with_their_checks():
    from gristmill.llm import exchange

    box = exchange.Outbox(1)
    keys, checks = np.array([5, 5, 7, 7, 9], np.uint64), np.array([1, 2, 3, 3, 4], np.uint64)
    box.add(keys, 11, np.arange(5), checks)
    box.add(keys[:1], 12, np.array([0]), checks[:1] + np.uint64(8))
    rows = [*box.flush()]
    k, d, p, c = exchange.unpacked([r[1:] for r in rows if np.frombuffer(r[3], np.int32)[0] >= 0])
    assert sorted(zip(k.tolist(), d.tolist(), p.tolist(), c.tolist())) == [(5, 11, 0, 1), (5, 11, 1, 2), (5, 12, 0, 9), (7, -1, 0, 3), (9, 11, 4, 4)]
    _, d, p, _ = exchange.unpacked([r[1:] for r in rows if np.frombuffer(r[3], np.int32)[0] < 0])
    assert sorted(zip(d.tolist(), (-1 - p).tolist())) == [(11, 2), (11, 3)]


# 10
def test_quality_counts_equal_brute_force(spark, docs, corpus):
    got = by_id(quality.judge(docs))
    for i, t, *_ in corpus:
        text = t or ""
        w = text.encode().split()
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(text[:80])
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality.judge(docs.where("false")).count() == 0


def test_quality_tells_odd_texts_apart(spark):
    rng = random.Random(9)
    fine = [(i, " ".join(rng.choice(["the", "of", "and", "in", *WORDS]) for _ in range(150)), "en") for i in range(60)]
    odd = [(900, "12:34 #### $$$$ 99/88 " * 20 + prose(rng, 20), "en")]
    got = by_id(quality.judge(spark.createDataFrame(fine + odd, "doc_id long, text string, lang string")))
    assert all(got[i].kept for i, *_ in fine) and not got[900].kept


def test_quality_distances_equal_brute_force(spark):
    rng = random.Random(29)
    heads = {"en": ["the", "of", "and"], "xx": ["ba", "du", "ri"]}
    rows = [(i, " ".join(rng.choice(heads[lang] * 3 + WORDS[:40]) + rng.choice(["", "", ",", ".", " 7"]) for _ in range(rng.randint(30, 120))), lang) for i in range(60) for lang in [["en", "xx"][i % 2]]]
    rows += [(100, "#1 $2 " * 60, "en"), (101, " ".join(WORDS[100:190]), "xx"), (102, None, "en"), (103, "ba du ri ka lo " * 5 + " ".join(WORDS[60:120]), None), (104, "THE OF AND " + prose(rng, 80).upper(), "en")]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), common_words=5, min_rows=20, spread=3.0))
    runs = lambda t: [w for w in re.split(r"[\W\d_]+", (t or "").lower()) if w]
    size = lambda t: len((t or "").encode().split())

    def classes(t):
        other = [sum(c.isalpha() for c in t) - sum(c.isupper() for c in t), sum(c.isupper() for c in t), sum(c in "0123456789" for c in t), sum(c in " \t\n\v\f\r" for c in t)]
        return np.array([*other, len(t) - sum(other)], float)

    def distance(p, q):
        p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
        part = lambda a: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(a, p + q - a) if x > 0)
        return np.sqrt(max(0, (part(p) + part(q)) / 2))

    solid = collections.defaultdict(list)
    for _, t, lang in rows:
        if size(t) >= 50:
            solid[lang or ""].append(t)
    counts = {lang: collections.Counter(w for t in ts for w in runs(t)) for lang, ts in solid.items()}
    # five words of each language are clearly more frequent than others, so they are among the sketch's candidates
    bins = sorted({w for c in counts.values() for w, _ in sorted(((w, n) for w, n in c.items()), key=lambda x: (-x[1], x[0]))[:5]})
    want = {}
    for i, t, lang in rows:
        if size(t) < 50:
            continue
        ts, ref = solid[lang or ""], counts[lang or ""]
        own, total = collections.Counter(runs(t)), max(len(runs(t)), size(t))
        q = [ref[w] for w in bins]
        q_all = sum(max(len(runs(x)), size(x)) for x in ts)
        p = [own[w] for w in bins]
        word = distance([*p, total - sum(p)], [*q, q_all - sum(q)])
        usual = sum(q) / q_all * total
        lacking = max(0, usual - sum(p))
        if sum(q) and (sum(p) >= 20 or (usual >= 20 and sum(q) / q_all >= 0.1)):
            word = max(word, distance([*p, lacking], [*q, 0]))
        want[i] = (distance(classes(t), sum(map(classes, ts))), word)
    for i, (a, b) in want.items():
        assert (got[i].class_distance, got[i].word_distance) == (pytest.approx(a, abs=1e-6), pytest.approx(b, abs=1e-6)), i
        assert got[i].kept == (not got[i].base_failed and a <= got[i].class_limit and b <= got[i].word_limit)
    by_lang = {lang: [want[i] for i, _, x in rows if x == lang and i in want and not got[i].base_failed] for lang in ("en", "xx")}
    for lang, held in by_lang.items():
        one = got[next(i for i, _, x in rows if x == lang)]
        for k, limit, low, high in ((0, one.class_limit, 0.15, 0.45), (1, one.word_limit, 0.5, 0.85)):
            v = sorted(x[k] for x in held)
            at = lambda f: v[max(0, int(np.ceil(f * len(v))) - 1)]  # noqa: E731, B023
            assert limit == pytest.approx(min(max(at(0.75) + 3 * (at(0.75) - at(0.25)), low), high), abs=0.02)
    assert not got[100].kept and got[102].class_distance is None


def test_quality_compares_texts_of_few_common_words(spark):
    rng = random.Random(19)
    fine = [(i, " ".join(rng.choice(["the", "of", "and", "in", *rng.sample(WORDS, 6)]) for k in range(150)), "en") for i in range(60)]
    few = [(900 + k, " ".join(["the"] * k + rng.sample(WORDS, 180)), "en") for k in (0, 1, 3, 5)] + [(910, "zq" * 3 + " " + " ".join(rng.sample(WORDS, 60)), "en")]
    other = [(950 + i, prose(rng, 150), "xx") for i in range(20)] + [(990, prose(rng, 150) + " the", "xx")]
    got = by_id(quality.judge(spark.createDataFrame(fine + few + other, "doc_id long, text string, lang string")))
    assert all(got[i].word_distance > 0.85 and not got[i].base_failed and not got[i].kept for i, *_ in few)
    assert all(got[i].word_distance is not None and got[i].kept for i, *_ in fine + other)


# pipeline
def test_pipeline_stages(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, rows, "")
        assert after.columns == rows.columns
        rows = spark.createDataFrame(after.collect(), rows.schema)
    packed = pipeline.STAGES[-1][1](spark, rows, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows.collect()}


def test_pipeline_run(spark, tmp_path):
    """The whole run against each stage worked out by hand: repeated ids and rows, nulls, empty and long texts, an extra column."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    rng = random.Random(51)
    words = {"en": WORDS[:80], "xx": [f"zu{w}ö" for w in WORDS[80:160]]}
    make = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    texts = {i: make(["en", "xx"][i % 2], 120) for i in range(60)}
    passage = make("en", 40)
    rows = [(i, t, ["en", "xx"][i % 2]) for i, t in texts.items()]
    rows += [(100, texts[4], "en"), (101, texts[6] + " more", "en"), (7, texts[8] + " tail", "xx"), (9, make("xx", 90), "xx"), (9, rows[9][1], "xx")]
    rows += [(200 + k, f"{make('en', 30)} {passage} {make('en', 30)}", "en") for k in range(3)]
    rows += [(300, make("en", 60) + " me@home.org " + make("en", 60), "en"), (301, make("en", 20_000), "en"), (400, None, "en"), (401, "", None), (402, "12 34", "xx"), (None, make("xx", 70), None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket int"
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1) for i, t, lang in rows], schema)
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.defaultdict(list)
    for r in pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id, r.doc_tokens].append(r)
    # rows without language, copies and near copies are gone; of 7 and 8 the near copy with the smaller id stays beside the other row of that id
    kept = [(i, t) for i, t, _ in rows if t and i not in (8, 100, 101, 402)]
    kept.remove((9, rows[9][1]))  # one of two equal rows
    want = collections.Counter()
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, t in kept:
        out = t.replace(f" {passage} ", " ") if i is not None and 200 <= i < 203 else t.replace("me@home.org", "[EMAIL]")
        want[i, len(coder.encode(out, add_special_tokens=False).ids) + 1] += 1
    assert {k[0] for k in got} == {k[0] for k in want}
    tokens = lambda i: sorted(n for (k, n), c in want.items() if k == i for _ in range(c))
    for i in {k[0] for k in want}:
        own = [r for (k, _), rs in got.items() if k == i for r in rs]
        assert sum(r.length for r in own) == sum(tokens(i)), i
    df.where("false").write.parquet(str(tmp_path / "empty/documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "empty")).count() == 0
