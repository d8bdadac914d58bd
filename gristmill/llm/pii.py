"""Personal data: base patterns, and terms that the corpus shows to disclose them. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality import let

# The four base patterns, written so that each attempt is linear. A run of characters that
# fails from its first position fails from all, hence the look-behinds; \G lets an address begin right
# behind another. Possessive repeats keep Java from recursing over long digit runs.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = "term"
#: The places of term spans: what is generalised becomes the mark [TERM], what is removed leaves nothing.
GENERALISE, REMOVE = len(KINDS), len(KINDS) + 1
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"
_OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
_WORD_GAP = "[^\\p{L}\\p{N}'-]+"
_SPAN = "array<struct<start:int,place:int,end:int,kind:string,value:string>>"


def _luhn(digits: Column) -> Column:
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    digit = lambda i: F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _checks(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["value"])


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def before(values: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of an int array what the ones before it come to, and last what all come to.

    Arrays can only grow by copies, so they are built in blocks of about the root of their length: the time grows as
    n * sqrt(n), with 100,000 elements a fraction of a second.
    """

    def grown(block: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, zero, lambda acc, x: F.struct(step(acc["at"], x).cast("int").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / width).cast("int")), lambda k: F.slice(v, k * width + 1, width))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, grown(F.transform(b, lambda x: F.aggregate(x, F.lit(start), lambda a, y: step(a, y).cast("int"))), F.lit(start)), grown)))

    # an element more takes what all come to
    return let(F.array_append(values, F.lit(start)), whole)


def located(text: Column, pattern: Column, kind: str, place: int) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches.

    Matches are marked in the text with two private characters, whose own occurrences were exchanged for a third
    before, then the text is cut at the marks and lengths are summed.
    """
    marked = F.regexp_replace(text, pattern, F.lit(f"{_OPEN}$0{_CLOSE}"))

    def spans(p: Column) -> Column:
        # every part but the first lost its opening mark and holds a closing one
        lengths = F.transform(p, lambda x, i: F.length(x) - F.when(i > 0, 1).otherwise(0))
        at = before(lengths, 0, lambda a, x: a + x)

        def span(part: Column, i: Column, starts: Column) -> Column:
            value = F.substring_index(part, _CLOSE, 1)
            start = F.get(starts, i + 1)
            return F.struct(start.alias("start"), F.lit(place).alias("place"), (start + F.length(value)).alias("end"), F.lit(kind).alias("kind"), value.alias("value"))

        return let(at, lambda starts: F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda part, i: span(part, i, starts)))

    return let(marked, lambda m: F.when(F.contains(m, F.lit(_OPEN)), let(F.split(m, _OPEN), spans)).otherwise(F.array().cast(_SPAN)))


#: Texts are cut from blocks of so many characters: a cut from the text itself reads all that stands before it.
_BLOCK = 512


def pieces(text: Column, spans: Column, body: Callable[[Callable[[Column, Column], Column], Column, Column], Column]) -> Column:
    """body(cut, spans, reach): cut(start, end) is that part of the text, and reach has the furthest end before each span, last of all."""

    def cut(blocks: Column) -> Callable[[Column, Column], Column]:
        def part(start: Column, end: Column) -> Column:
            first = F.floor(start / _BLOCK).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1), "")
            return F.when(end > start, F.substr(near, start - first * _BLOCK + 1, end - start)).otherwise("")

        return part

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    reach = let(spans, lambda s: before(F.transform(s, lambda x: x["end"]), 0, F.greatest))
    return let(F.struct(blocks.alias("b"), spans.alias("s"), reach.alias("r")), lambda x: body(cut(x["b"]), x["s"], x["r"]))


def base_spans(text: Column) -> Column:
    """The valid base spans of a text, by start, then kind."""
    hint = {"email": "@", "phone": "+", "ip": ".", "card": ""}
    found = []
    for place, (kind, pattern) in enumerate(KINDS.items()):
        spans = F.filter(located(text, F.lit(pattern), kind, place), _checks(kind))
        found.append(F.when(F.contains(text, F.lit(hint[kind])) if hint[kind] else text.rlike("[0-9][ -]?[0-9]"), spans).otherwise(F.array().cast(_SPAN)))
    return F.sort_array(F.concat(*found))


def words(text: Column) -> Column:
    """Distinct lower-case words of any length: runs of letters, digits, ' and - with a letter or digit."""
    return F.filter(F.array_distinct(F.split(F.lower(text), _WORD_GAP)), lambda w: F.btrim(w, F.lit("'-")) != "")


def digest(text: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _entity(span: Column) -> Column:
    return F.xxhash64(span["kind"], F.lower(span["value"]))


def _company(text: Column, spans: Column) -> Column:
    """(term, inside) of every distinct word of a text with spans: inside is the entity whose spans alone hold the word, null for all others."""

    def each(cut: Callable[[Column, Column], Column], s: Column, reach: Column) -> Column:
        gaps = F.array_append(F.transform(s, lambda x, i: F.when(x["start"] > F.get(reach, i), cut(F.get(reach, i), x["start"])).otherwise("")), cut(F.element_at(reach, -1), F.length(text)))
        row = lambda w, place, entity: F.struct(w.alias("term"), F.lit(place).alias("place"), entity.cast("long").alias("inside"))
        held = F.flatten(F.transform(s, lambda x: let(_entity(x), lambda e: F.transform(words(x["value"]), lambda w: row(w, 2, e)))))
        plain = lambda w, place: F.transform(w, lambda x: row(x, place, F.lit(None)))
        # sorted, the rows of a word are neighbours: in the text (a span can end within a word), outside of spans, in those of each entity
        every = F.sort_array(F.concat(plain(words(text), 0), plain(words(F.array_join(gaps, " ")), 1), held))
        same = lambda x, y: (x["term"] == y["term"]) & (x["place"] == y["place"]) & x["inside"].eqNullSafe(y["inside"])
        rows = let(every, lambda r: F.filter(r, lambda x, i: (i == 0) | ~same(x, F.get(r, i - 1))))

        def alone(r: Column) -> Column:
            def inside(x: Column, i: Column) -> Column:
                near, beyond = F.get(r, i + 1), F.get(r, i + 2)
                return F.when((near["term"] == x["term"]) & (near["place"] == 2) & ~F.coalesce(beyond["term"] == x["term"], F.lit(False)), near["inside"])

            return F.filter(F.transform(r, lambda x, i: F.when(x["place"] == 0, F.struct(x["term"].alias("term"), inside(x, i).alias("inside")))), lambda x: x.isNotNull())

        return let(rows, alone)

    return F.when(F.size(spans) > 0, pieces(text, spans, each)).otherwise(F.array().cast("array<struct<term:string,inside:bigint>>"))


def clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, _OTHER * 2)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, base spans, the words of texts that hold any, and a row number (kept once the table is written)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean(F.col("text")).alias("text"))
    spans = base.withColumn("spans", base_spans(F.col("text")))
    return spans.select("doc_id", digest(F.col("text")).alias("digest"), "spans", _company(F.col("text"), F.col("spans")).alias("near"), F.monotonically_increasing_id().alias("row"))


def _small(df: DataFrame, broadcast_rows: int) -> DataFrame:
    """df to be broadcast if a count finds at most so many rows."""
    return F.broadcast(df) if df.count() <= broadcast_rows else df


def disclosing_terms(docs: DataFrame, found: DataFrame, min_texts: int = 3, disclosure: float = 0.8, removal: float = 0.95, broadcast_rows: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """(term, share, action): terms that disclose a protected entity, from counts over all distinct texts; and (digest, term) of
    all texts that hold a term which was counted.

    An entity is a base span's value. With n texts, n_e with the entity, n_t with the term anywhere and n_te with the
    term anywhere but in the entity itself, the term discloses the share PMI(t, e) / IC(e) =
    log(n n_te / (n_t n_e)) / log(n / n_e) of the entity's information: 1 when the term never occurs without it.
    Terms whose share reaches ``disclosure`` with ``min_texts`` texts are generalised, from ``removal`` on removed.
    """
    n = float(found.select("digest").distinct().count())
    holders = found.where(F.size("spans") > 0)
    entities = holders.select("digest", F.explode("spans").alias("s")).select("digest", _entity(F.col("s")).alias("entity")).distinct()
    # n_te is n_e at most, so entities of fewer than min_texts texts have no terms
    with_entity = entities.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") < n) & (F.col("n_e") >= min_texts))
    held = written(entities.join(with_entity, "entity"))
    most = held.agg(F.max("n_e")).first()[0]
    empty = docs.select(F.lit("").alias("term"), F.lit(0.0).alias("share"), F.lit("").alias("action")).where("false")
    nowhere = found.select("digest", F.lit("").alias("term")).where("false")
    if most is None:
        return empty, nowhere
    by_text = held.groupBy("digest").agg(F.collect_list(F.struct("entity", "n_e")).alias("entities"))
    first = holders.groupBy("digest").agg(F.min("row").alias("row")).join(by_text, "digest").select("row", "entities")
    texts = written(found.select("row", "near").join(_small(written(first), broadcast_rows), "row").select("near", "entities"))
    # a term stands in as many texts as it is with any entity in, at least, and in as many as it is in of those that have no
    # copy: with n_te at most n_e and n_near, these bound its share before pairs are made, and again before all texts are counted
    reach = lambda n_e: F.log2(n / F.greatest(F.col("n_near"), n_e)) >= disclosure * F.log2(n / n_e)
    near_any = texts.select(F.explode("near").alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.count("*").alias("n_near")).where((F.col("n_near") >= min_texts) & reach(F.lit(float(most))))
    near_any = _small(written(near_any), broadcast_rows)
    # the digest is a column before the words are spread, so it isn't taken again for each of them
    whole = docs.select(clean(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    copied = found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    alone = whole.join(_small(written(copied), broadcast_rows), "digest", "left_anti").select(F.explode(words(F.col("text"))).alias("term"))
    n_alone = alone.join(near_any, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_alone"))
    near_any = near_any.join(n_alone, "term", "left").select("term", F.greatest("n_near", F.coalesce("n_alone", F.lit(0))).alias("n_near")).where(reach(F.lit(float(most))))
    near_any = _small(written(near_any), broadcast_rows)
    share = lambda n_t: F.log2(n * F.col("n_te") / (F.col(n_t) * F.col("n_e"))) / F.log2(n / F.col("n_e"))
    known = texts.select("entities", F.explode("near").alias("x")).select("entities", "x.term", "x.inside").join(near_any, "term")
    both = known.select("term", "inside", "n_near", F.explode("entities").alias("e")).select("term", "inside", "n_near", "e.entity", "e.n_e").where((F.col("inside").isNull() | (F.col("inside") != F.col("entity"))) & reach(F.col("n_e")))
    pairs = both.groupBy("entity", "term", "n_e", "n_near").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= min_texts)
    pairs = written(pairs.where(share("n_near") >= disclosure))
    terms = pairs.select("term").distinct()
    asked = terms.count()
    if not asked:
        return empty, nowhere
    terms = F.broadcast(terms) if asked <= broadcast_rows else terms
    spread = whole.select("digest", F.explode(words(F.col("text"))).alias("term"))
    holds = written(spread.join(terms, "term", "left_semi").distinct().select("digest", "term"))
    with_term = holds.groupBy("term").agg(F.count("*").alias("n_t"))
    scored = pairs.join(with_term, "term").select("term", share("n_t").alias("share")).groupBy("term").agg(F.max("share").alias("share"))
    found_terms = scored.where(F.col("share") >= disclosure).select("term", "share", F.when(F.col("share") >= removal, "remove").otherwise("generalise").alias("action"))
    return written(found_terms), holds


def term_spans(docs: DataFrame, terms: DataFrame, holds: DataFrame, broadcast_rows: int = 300_000) -> DataFrame:
    """(digest, extra): every occurrence of disclosing terms in the distinct texts that hold any."""
    texts = docs.select(clean(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    each = holds.join(_small(terms.select("term", "action"), broadcast_rows), "term")
    of = lambda action: F.array_join(F.sort_array(F.collect_list(F.when(F.col("action") == action, F.col("term")))), "|")
    held = written(each.groupBy("digest").agg(of("generalise").alias("broad"), of("remove").alias("gone")))
    # terms hold letters, digits, ' and - only, so they stand for themselves in a pattern
    pattern = lambda any_: F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}'-])(?:"), F.col(any_), F.lit(")(?![\\p{L}\\p{N}'-])"))
    spans = lambda any_, place: F.when(F.col(any_) != "", located(F.col("text"), pattern(any_), TERM, place)).otherwise(F.array().cast(_SPAN))
    found = texts.join(_small(held, broadcast_rows), "digest").select("digest", F.concat(spans("broad", GENERALISE), spans("gone", REMOVE)).alias("extra"))
    return _small(written(found.dropDuplicates(["digest"])), broadcast_rows)


def findings(docs: DataFrame, **limits: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, spans, extra) of every row, and the disclosing terms."""
    found = written(scanned(docs))
    terms, holds = disclosing_terms(docs, found, **limits)
    rows = found.select("doc_id", "digest", "spans")
    if not terms.limit(1).count():
        return rows.withColumn("extra", F.array().cast(_SPAN)), terms
    return rows.join(term_spans(docs, terms, holds), "digest", "left").withColumn("extra", F.coalesce("extra", F.array().cast(_SPAN))), terms


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def detect(docs: DataFrame, **limits: float) -> DataFrame:
    """Counts of base spans, their digest, and all spans of every whole text.

    Null text: empty. Rows are judged one by one; equal texts get equal spans. Other columns are not read. Counts are of
    distinct texts, so copies don't make a term disclose. The base spans and word counts cover all documents; only tables with a
    checked number of rows are broadcast.
    """
    rows, _ = findings(docs, **limits)
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("spans", "extra"))).alias("spans"))


def redacted_text(text: Column, spans: Column) -> Column:
    """The text with each span exchanged for its kind in brackets, or for nothing where a term is removed; spans that overlap are one."""

    def whole(cut: Callable[[Column, Column], Column], s: Column, reach: Column) -> Column:
        mark = lambda x: F.when(x["place"] == REMOVE, "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        each = F.transform(s, lambda x, i: F.when(x["start"] >= F.get(reach, i), F.concat(cut(F.get(reach, i), x["start"]), mark(x))).otherwise(""))
        return F.concat(F.array_join(each, ""), cut(F.element_at(reach, -1), F.length(text)))

    return pieces(text, spans, whole)


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """docs with base spans and disclosing terms exchanged for their kinds or, from the removal share on, deleted from text, all else as it was; null texts stay null."""
    found = written(scanned(docs))
    terms, holds = disclosing_terms(docs, found, **limits)
    text = clean(F.col("text"))
    if terms.limit(1).count():
        rows = docs.withColumn("_digest", digest(text)).join(term_spans(docs, terms, holds).withColumnRenamed("digest", "_digest"), "_digest", "left")
        spans = F.sort_array(F.concat(base_spans(text), F.coalesce("extra", F.array().cast(_SPAN))))
    else:
        rows, spans = docs, base_spans(text)
    held = rows.withColumn("_spans", F.when(F.col("text").isNotNull(), spans))
    new = F.when(F.size("_spans") > 0, redacted_text(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    return held.withColumn("text", new).select(docs.columns)
