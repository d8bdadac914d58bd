"""Chat formatting: quoted passages are linked to the messages they come from. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_QUOTE = "^[ \\t]*>"
_PREFIX = "^((?:[ \\t]*>)+)[ \\t]*"
#: How mail programs announce a quote, in four languages; dropped when a quote follows.
_ANNOUNCED = "(?m)^[^\\n]*(?:wrote|écrit|schrieb|escribió) ?:[ \\t]*\\r?\\n(?=[ \\t]*>)"


_SOURCES = "array<struct<passage:int,level:int,source_turn:{},matched:bigint>>"
#: The same of an announcement that stands in a quote: it doesn't part the quote.
_ANNOUNCED_IN_QUOTE = _ANNOUNCED.replace("^[^", "^(?=[ \\t]*>)[^", 1)


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _ANNOUNCED, ""), "\\r?\\n")


def normal_hash(line: Column) -> Column:
    """Hash of a line without case, edge space and differences of inner space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), "[\\s\\u00a0]+", " ")))


def _says_something(line: Column) -> Column:
    return line.rlike("[\\p{L}\\p{N}]")


def _passages(text: Column) -> Column:
    """Quoted lines between two lines that aren't quoted, as arrays; announcements count as lines between."""
    every = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _ANNOUNCED_IN_QUOTE, ""), "\\r?\\n")
    bare = F.array_join(F.transform(every, lambda x: F.when(x.rlike(_QUOTE), x).otherwise("")), "\n")
    return F.transform(F.split(bare, "\n\n+"), lambda b: F.filter(F.split(b, "\n"), lambda x: x.rlike(_QUOTE) & _says_something(x)))


def parsed(messages: DataFrame) -> DataFrame:
    """messages with own (lines that aren't quoted) and quoted (array of passage, level, line hash)."""
    split = messages.withColumn("_lines", lines(F.col("text")))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _PREFIX, 1), "[^>]", ""))
    quoted = F.flatten(F.transform(_passages(F.col("text")), lambda b, i: F.transform(b, lambda x: F.struct(i.alias("passage"), level(x).alias("level"), normal_hash(F.regexp_replace(x, _PREFIX, "")).alias("h")))))
    return split.withColumn("own", F.filter("_lines", lambda x: ~x.rlike(_QUOTE))).withColumn("quoted", F.array_distinct(quoted)).drop("_lines")


def links(held: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, passage, level, source_turn, matched): where each quoted passage of a message comes from.

    A passage is the lines of one level between two lines that aren't quoted. It comes from the earlier message of the
    conversation that says most of its lines outside quotes, ties to the later one. Votes are counted once for each
    distinct set of lines in a conversation, however many messages quote it; each of these takes the best of the turns before.
    """
    quotes = held.where(F.size("quoted") > 0).select("conv_id", "turn", "digest", F.explode("quoted").alias("q")).select("conv_id", "turn", "digest", "q.passage", "q.level", "q.h")
    asking = written(quotes.groupBy("conv_id", "turn", "digest", "passage", "level").agg(F.array_sort(F.collect_set("h")).alias("hs")).distinct().withColumn("lines", F.xxhash64("hs")))
    sets = asking.select("conv_id", "lines", "hs").dropDuplicates(["conv_id", "lines"]).select("conv_id", "lines", F.explode("hs").alias("h"))
    said = held.join(asking.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode(F.array_distinct(F.transform(F.filter("own", _says_something), normal_hash))).alias("h")).distinct()
    votes = sets.join(said, ["conv_id", "h"]).groupBy("conv_id", "lines", "turn").agg(F.count("*").alias("n"))
    # behind each turn that votes, the best so far; a passage reads it before its own turn
    none = F.lit(None)
    marks = votes.select("conv_id", "lines", "turn", F.struct("n", F.col("turn").alias("source_turn")).alias("vote"), none.cast("long").alias("digest"), none.cast("int").alias("passage"), none.cast("int").alias("level"))
    reads = asking.select("conv_id", "lines", "turn", none.cast(marks.schema["vote"].dataType).alias("vote"), "digest", "passage", "level")
    before = Window.partitionBy("conv_id", "lines").orderBy("turn", F.col("vote").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = marks.unionByName(reads).withColumn("best", F.max("vote").over(before)).where("passage is not null and best is not null")
    return best.select("conv_id", "turn", "digest", "passage", "level", F.col("best.source_turn").alias("source_turn"), F.col("best.n").alias("matched"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of every replying turn, by pointer jumping: the rounds grow with the logarithm of the depth."""
    at = written(parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).alias("depth")))
    while True:
        above = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        after = written(at.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count()
        at = after.drop("moved")
        if not moved:
            return at.withColumnRenamed("up", "root_turn")


def link(messages: DataFrame) -> DataFrame:
    """Messages without their quotes, in an order in which replies follow what they quote.

    Returns conv_id, turn, role, text (quotes and their announcements taken out), parent_turn (the source
    of the first-level passage with most lines found, ties to the later source; null: no such quote of the conversation),
    root_turn (where that leads), depth, n_quoted and n_linked (quoted lines, and those found in the sources), and sources
    (passage, level, source_turn, matched of every linked passage in order). Sorting by conv_id, root_turn, turn reads each
    thread in reply order; the operator leaves that sort to the writer, so no conversation has to fit a task.

    Quotes of later turns, of the message itself and of other conversations link to nothing. Null conv_id, turn or
    text link nothing; their rows come back with what they have. Repeated rows come back as often; of several messages with one
    turn each is linked by its own text. Other columns are not read.
    """
    base = parsed(messages.select("conv_id", "turn", "role", "text")).withColumn("digest", F.xxhash64("role", "text"))
    found = written(links(base.where("conv_id is not null and turn is not null")))
    text = F.when(F.col("text").isNotNull(), F.rtrim(F.array_join("own", "\n"))).alias("text")
    kept = F.when(F.size("quoted") > 0, text).otherwise(F.col("text")).alias("text")
    rows = base.select("conv_id", "turn", "role", kept, "digest", F.size("quoted").cast("long").alias("n_quoted"))
    names = ["conv_id", "turn", "role", "text", "parent_turn", "root_turn", "depth", "n_quoted", "n_linked", "sources"]
    no_sources = F.array().cast(_SOURCES.format(base.schema["turn"].dataType.simpleString()))
    if not found.limit(1).count():
        return rows.select("conv_id", "turn", "role", "text", F.lit(None).cast(base.schema["turn"].dataType).alias("parent_turn"), F.col("turn").alias("root_turn"), F.lit(0).alias("depth"), "n_quoted", F.lit(0).cast("long").alias("n_linked"), no_sources.alias("sources"))
    near = found.groupBy("conv_id", "turn", "digest").agg(F.max(F.when(F.col("level") == 1, F.struct("matched", "source_turn")))["source_turn"].alias("parent_turn"), F.sum("matched").alias("n_linked"), F.sort_array(F.collect_list(F.struct("passage", "level", "source_turn", "matched"))).alias("sources"))
    # a turn has one place in the tree: of several messages of one turn the smallest parent
    tree = threads(near.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("parent_turn")))
    return rows.join(near, ["conv_id", "turn", "digest"], "left").join(tree, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("sources", no_sources).alias("sources")).select(names)
