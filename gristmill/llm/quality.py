"""Quality rules: base counts, and the divergence of a document's histograms from its language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The symbols that the base rules count.
SYMBOLS = "#*$%&|<>"
SEPARATOR_RUN = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, size: int = 3) -> Column:
    """How many words stand in windows of ``size`` words that the text holds twice or more.

    Windows are compared by 64-bit hash. Texts whose windows all differ stop after a hash-set test;
    for others the (hash, start) pairs are sorted, equal neighbours give the repeated starts, and each
    start adds the words up to the next one, ``size`` at most.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(size)]))

    def starts(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = let(pairs, lambda s: F.transform(s, lambda x, k: F.when(
            ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), x["i"])))
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    count = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(starts(hs), covered)))
    return F.when(F.size(words) < size, F.lit(0).cast("long")).otherwise(count)


def letter_runs(text: Column) -> Column:
    """Words without digits and marks, in lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: w != "")


def candidate_words(docs: DataFrame, each: int, tracked: int = 8192) -> list[str]:
    """Words among which the ``each`` / 4 most frequent of every language surely are: a mergeable sketch over all words of
    all documents; a word of over 1 / ``tracked`` of its language's words is always in it."""
    words = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(letter_runs(F.coalesce(F.col("text"), F.lit("")))).alias("w"))
    found = words.where(F.length("w") <= 64).groupBy("lang").agg(F.expr(f"approx_top_k(w, {each}, {tracked})").alias("top")).collect()
    return sorted({x["item"] for r in found for x in r.top})


def common_histogram(words: Column, bins: list[str]) -> Column:
    """array<struct<w, n>>: those words of the text that are bins, counted."""
    hits = F.sort_array(F.filter(words, lambda w: w.isin(bins)))

    def counted(s: Column) -> Column:
        distinct = F.array_distinct(s)  # keeps the sorted order
        return let(distinct, lambda d: F.transform(d, lambda w, k: F.struct(
            w.alias("w"), (F.coalesce(F.array_position(s, F.get(d, k + 1)), F.size(s) + 1) - F.array_position(s, w)).alias("n"))))

    return let(hits, counted)


def features(docs: DataFrame, bins: list[str]) -> DataFrame:
    """One row for each document: base counts, four character-class counts, counts of the words in ``bins`` and n_bins, all words with and without letters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), text.alias("text"))
    split = base.withColumn("words", F.filter(F.split("text", SEPARATOR_RUN), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    low = letter_runs(F.col("text"))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    counted = split.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(f"[{SYMBOLS}]+").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        without("\\p{L}+").cast("long").alias("n_letters"),
        without("\\p{Lu}+").cast("long").alias("n_upper"),
        without("[0-9]+").cast("long").alias("n_digits"),
        F.length("text").cast("long").alias("n_chars"),
        F.greatest(F.size(low), F.size("words")).cast("long").alias("n_bins"),
        common_histogram(low, bins).alias("common"),
    )
    return counted


#: Character classes of the histogram: other letters, capitals, digits, white space, the rest.
def class_shares(r) -> list[Column]:
    return [r["n_letters"] - r["n_upper"], r["n_upper"], r["n_digits"], r["n_chars"] - r["word_chars"], r["n_chars"] - r["n_letters"] - r["n_digits"] - (r["n_chars"] - r["word_chars"])]


def _divergence(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m) / 2).otherwise(F.lit(0.0))
    return part(p) + part(q)


def word_sums(feats: DataFrame, min_words: int) -> DataFrame:
    """(ref_lang, w, n): counts of the bins over all documents of ``min_words`` or more of each language."""
    lang = F.coalesce("lang", F.lit(""))
    return feats.where(F.col("n_words") >= min_words).select(lang.alias("ref_lang"), F.explode("common").alias("c")).groupBy("ref_lang", "c.w").agg(F.sum("c.n").alias("n"))


def references(feats: DataFrame, words: DataFrame, min_words: int) -> DataFrame:
    """One row for each language: summed character classes and common-word counts of all its documents of ``min_words`` or more."""
    lang = F.coalesce("lang", F.lit(""))
    solid = feats.where(F.col("n_words") >= min_words)
    sums = solid.groupBy(lang.alias("ref_lang")).agg(*[F.sum(c.cast("double")).alias(f"q{i}") for i, c in enumerate(class_shares({k: F.col(k) for k in feats.columns}))], F.sum(F.col("n_bins").cast("double")).alias("ref_bins"))
    hist = words.groupBy("ref_lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", F.col("n").cast("double"))))).alias("ref_words"), F.sum(F.col("n").cast("double")).alias("ref_total"))
    return sums.join(hist, "ref_lang", "left")


def limits(measured: DataFrame, spread: float, min_rows: int, least: tuple[float, float], most: tuple[float, float]) -> DataFrame:
    """(ref_lang, class_limit, word_limit): the upper quartile of a language's distances and ``spread`` times the distance of
    its quartiles beyond, kept between ``least`` and ``most``; under ``min_rows`` documents ``most``."""
    rows = measured.where("not base_failed").groupBy("ref_lang")
    names = ("class", "word")
    found = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(f"{k}_distance", [0.25, 0.75], 10_000).alias(k) for k in names])
    limit = lambda k, low, high: F.when(F.col("n") >= min_rows, F.least(F.greatest(F.get(k, F.lit(1)) + spread * (F.get(k, F.lit(1)) - F.get(k, F.lit(0))), F.lit(low)), F.lit(high))).otherwise(high)
    return found.select("ref_lang", *[limit(F.col(k), low, high).alias(f"{k}_limit") for k, low, high in zip(names, least, most)])


def judge(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, common_words: int = 24, spread: float = 8.0, min_rows: int = 100, least: tuple[float, float] = (0.15, 0.5), most: tuple[float, float] = (0.45, 0.85), min_common: int = 20, min_share: float = 0.1, broadcast_languages: int = 1000) -> DataFrame:
    """Base counts and verdict, the two Jensen-Shannon distances (0 to 1) behind the verdict, and their limits.

    The histograms of a document are compared with those of all documents of its ``lang`` (null: the rows without lang): its
    character classes, and its common words, which are the ``common_words`` most frequent of each language, of all documents. Guard:
    under ``min_words`` words no distance is taken (the base rule already fails such a text). The word distance is the larger of
    two: over the common words and one bin of all other words; and over the common words alone, where those that the text
    lacks of the number usual in its language count as a bin which the language doesn't have, so a text without any is at 1. The
    second is taken if the text holds ``min_common`` common words, or should: at least that many are usual for its length, in a
    language of which they are ``min_share`` or more. A text is kept if neither distance passes the limit of its language, which
    comes from the quartiles of all its documents (see limits).

    Null text: empty, zero counts, base_failed. Repeated rows are judged alike, one row each. DataFrame functions only; features
    and distances are written once to the shared folder, and references and limits are a few rows for each language.
    """
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_languages else df
    feats = written(features(docs, candidate_words(docs, 4 * common_words)))
    counts_all = written(word_sums(feats, min_words))
    ranked = counts_all.withColumn("rank", F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("n"), "w"))).where(F.col("rank") <= common_words)
    bins = sorted(r.w for r in ranked.select("w").distinct().collect())
    feats = feats.withColumn("common", F.filter("common", lambda c: c["w"].isin(bins)))
    refs = small(written(references(feats, counts_all.where(F.col("w").isin(bins)), min_words)))
    both = feats.withColumn("ref_lang", F.coalesce("lang", F.lit(""))).join(refs, "ref_lang", "left")
    shares = class_shares({k: F.col(k) for k in feats.columns})
    total_q = sum((F.col(f"q{i}") for i in range(1, 5)), F.col("q0"))
    class_js = sum((_divergence(c / F.col("n_chars"), F.col(f"q{i}") / total_q) for i, c in enumerate(shares)), F.lit(0.0))
    n_common = F.aggregate("common", F.lit(0).cast("double"), lambda a, c: a + c["n"])
    ref_total = F.coalesce("ref_total", F.lit(0.0))
    ref = lambda w: F.coalesce(F.element_at("ref_words", w), F.lit(0.0))

    def distance(p_total: Column, p_other: Column, q_total: Column, q_other: Column) -> Column:
        seen = F.aggregate("common", F.lit(0.0), lambda a, c: a + _divergence(F.try_divide(c["n"].cast("double"), p_total), F.try_divide(ref(c["w"]), q_total)))
        unseen = F.try_divide(ref_total - F.aggregate("common", F.lit(0.0), lambda a, c: a + ref(c["w"])), q_total)
        return seen + unseen / 2 + _divergence(F.try_divide(p_other, p_total), F.try_divide(q_other, q_total))

    def word_divergence(n: Column) -> Column:
        whole = distance(F.col("n_bins"), F.col("n_bins") - n, F.col("ref_bins"), F.col("ref_bins") - ref_total)
        share = F.try_divide(ref_total, F.col("ref_bins"))
        usual = share * F.col("n_bins")
        lacking = F.greatest(usual - n, F.lit(0.0))
        known = (ref_total > 0) & ((n >= min_common) | ((usual >= min_common) & (share >= min_share)))
        return F.greatest(whole, F.when(known, distance(n + lacking, lacking, ref_total, F.lit(0.0))))

    word_js = let(n_common, word_divergence)
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measured = written(both.select("ref_lang", *counts, failed.alias("base_failed"), F.when(F.col("n_words") >= min_words, root(class_js)).alias("class_distance"), F.when(F.col("n_words") >= min_words, root(word_js)).alias("word_distance")))
    far = (F.coalesce("class_distance", F.lit(0.0)) > F.coalesce("class_limit", F.lit(most[0]))) | (F.coalesce("word_distance", F.lit(0.0)) > F.coalesce("word_limit", F.lit(most[1])))
    judged = measured.join(small(written(limits(measured, spread, min_rows, least, most))), "ref_lang", "left")
    return judged.select(*counts, "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance", "class_limit", "word_limit")
