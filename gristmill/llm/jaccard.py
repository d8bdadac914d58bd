"""Exact n-gram Jaccard join and its connected components, by a grouped prefix join.

Sets of 64-bit shingle hashes; equal sets are one node from the start. The join has two prefix filters:

1. The smallest hashes of each set, a little over half of it, are counted over all sets. A set with a partner has
   more than half of these in common with it, so a set whose counted hashes mostly occur nowhere else is out.
2. What is left is ordered by count, the rarest first, and cut to its prefix. Nodes with the same size and
   prefix are one group; groups meet at the elements of their prefixes; group pairs are filtered by size
   and position; what remains is expanded to its members, and those are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordHashes, batch_of, exchange_width, mixed, released, small_batches, window_hashes, written
from .exchange import doc_bucket, exchanged, key_bucket, lots, packed


def shingle_set(text: str | bytes | None, size: int, table: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of the lower-cased words; fewer words than ``size``: one hash of them all."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = data.translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        return mixed(window_hashes(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(hashes, size))


class Names:
    """The name of a set: ``bits`` of its hash, unless another set has these too; ``other`` then names it by all 128 bits."""

    def __init__(self, bits: int = 64, other: dict[tuple[int, int], int] | None = None):
        self.bits, self.other = bits, other or {}

    def both(self, shingles: np.ndarray) -> tuple[int, int]:
        """The name and a further check, as signed 64-bit values."""
        import xxhash

        whole = xxhash.xxh3_128_intdigest(shingles.tobytes())
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        name, check = signed((whole >> 64) >> (64 - self.bits)), signed(whole & (1 << 64) - 1)
        return self.other.get((name, check), name), check


class Bounds:
    """What a pair with Jaccard similarity of ``percent`` / 100 or more has in common in the smallest hashes of its sets.

    Of a set with n elements the ``sample(n)`` smallest are counted. For two sets of n and m elements the one whose
    sample ends first has all of it within the other's, but for the at most n - o elements that aren't in common, with o
    the least intersection. So the samples share sample(n) - n + o, or the same with m, whichever is less.
    """

    def __init__(self, percent: int):
        self.percent, self.share, self._least = percent, min(100, 130 - percent), {}

    def sample(self, n):  # noqa: ANN001, ANN201  numbers or arrays
        return np.minimum(n, n * self.share // 100 + 8)

    def least(self, n: int) -> int:
        """The least number of sampled elements that a set of n has in common with any similar set."""
        if n not in self._least:
            m = np.arange(-(-n * self.percent // 100), n * 100 // self.percent + 1)
            o = -(-self.percent * (n + m) // (100 + self.percent))
            self._least[n] = max(1, int(np.minimum(self.sample(n) - n + o, self.sample(m) - m + o).min()))
        return self._least[n]

    def may_reach(self, a: str, b: str) -> str:
        """SQL: whether two prefix rows (n, rest) leave room: by size, and by the sampled elements from this one on."""
        both, t = f"({a}n + {b}n)", self.percent
        sample = lambda x: f"least({x}n, {x}n * {self.share} div 100 + 8)"
        least = f"least({sample(a)} - {a}n, {sample(b)} - {b}n) + ({t} * {both} + {99 + t}) div {100 + t}"
        return f"100 * least({a}n, {b}n) >= {t} * greatest({a}n, {b}n) and least({a}rest, {b}rest) >= {least}"

    def may_match(self, a: str, b: str) -> str:
        """SQL: whether the parity bits of two members leave room."""
        differ = " + ".join(f"bit_count({a}{x} ^ {b}{x})" for x in BITS)
        return f"({differ}) * {100 + self.percent} <= {100 - self.percent} * ({a}n + {b}n)"

    def may_join(self, a: str, b: str) -> str:
        """SQL: the same of a member and a unit."""
        differ = " + ".join(f"bit_count(({a}{x} & ~{b}any_{x}) | ({b}all_{x} & ~{a}{x}))" for x in BITS)
        return f"({differ}) * {100 + self.percent} <= {100 - self.percent} * ({a}n + {b}n)"

    def may_hold(self, a: str, b: str) -> str:
        """SQL: the same of two units of members, by the bits that all members of the one have and none of the other."""
        differ = " + ".join(f"bit_count(({a}all_{x} & ~{b}any_{x}) | ({b}all_{x} & ~{a}any_{x}))" for x in BITS)
        return f"({differ}) * {100 + self.percent} <= {100 - self.percent} * ({a}n + {b}n)"


BITS = [f"b{i}" for i in range(8)]


def parity_bits(shingles: np.ndarray) -> list[int]:
    """512 bits, each the parity of the elements that fall on it: two sets differ in at least as many elements as in bits."""
    counts = np.bincount((mixed(shingles) >> np.uint64(55)).astype(np.int64), minlength=512)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


ROWS = "doc_id long, row_key long, node long, proof long, n_shingles long"


def nodes(docs: DataFrame, size: int, names: Names) -> DataFrame:
    """Of every row its id, a hash of id and text, the set's node with its check, and the set's size; rows without words have no node."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for b in batches:
            found = []
            for t in b.column(2):
                shingles = shingle_set(t.as_py(), size, table)
                found.append((*(names.both(shingles) if len(shingles) else (None, None)), len(shingles)))
            yield batch_of(schema, [b.column(0), b.column(1), *([f[k] for f in found] for k in range(3))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(released(run), ROWS)


def named_rows(docs: DataFrame, size: int, bits: int) -> tuple[DataFrame, Names]:
    """The written rows of nodes(), and names under which no two different sets share a node.

    Names are told apart by 128 bits. Sets whose first ``bits`` agree are rare (about n * n / 2**65 of n sets), so the
    driver may hold them; all but one of them get a name from all their bits and the table is written again.
    """
    names = Names(bits)
    while True:
        rows = written(nodes(docs, size, names))
        same = rows.where("node is not null").groupBy("node").agg(F.min("proof").alias("low"), F.max("proof").alias("high")).where("low <> high").select("node")
        clash = rows.join(same, "node").groupBy("node", "proof").count().collect()
        if not clash:
            return rows, names
        first = {r.node: min(x.proof for x in clash if x.node == r.node) for r in clash}
        import xxhash

        turn = len(names.other)
        fresh = {(r.node, r.proof): xxhash.xxh3_64_intdigest(f"{r.node}:{r.proof}:{turn}".encode()) - (1 << 63) for r in clash if r.proof != first[r.node]}
        # a name that was given in an earlier turn is found again under the set's own name
        given = {v: k for k, v in names.other.items()}
        names = Names(bits, names.other | {(given.get(node, (node, proof))[0], proof): new for (node, proof), new in fresh.items()})


#: A hash that a task holds this often is frequent wherever it occurs: its places are answered in the task.
FREQUENT_IN_TASK, FREQUENT = 32, 2**31 - 1
#: Rows that a receiver sorts at once.
LOT = 2_000_000
ASKED, MARK, FACT, ANSWER = range(4)
_MESSAGE = "bucket int, kind int, keys binary, nodes binary, counts binary"
_MESSAGE_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("counts", pa.binary())])


def _messages(*lots: tuple) -> Iterator[pa.RecordBatch]:
    """(kind, buckets, keys, nodes, counts) lots as one row for each kind and bucket."""
    for kind, buckets, *columns in lots:
        if rows := [(b, kind, *x) for b, *x in packed(buckets, *columns)]:
            yield batch_of(_MESSAGE_SCHEMA, [*map(list, zip(*rows))])


def _received(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held: dict[int, list] = {kind: [] for kind in range(4)}
    for b in batches:
        for _, kind, *x in zip(*(c.to_pylist() for c in b.columns)):
            held[kind].append(x)
    found = {}
    for kind in held:
        found[kind] = tuple(np.frombuffer(b"".join(x[i] for x in held[kind]), t) for i, t in enumerate((np.uint64, np.int64, np.int32)))
        held[kind] = []
    return found


def counted(docs: DataFrame, size: int, bounds: Bounds, names: Names, width: int) -> DataFrame:
    """Messages for each node's bucket: its size, and those of its sampled hashes that other sets have too, with their counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, held, count = WordHashes(), set(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([h[0] for h in held])
            own = np.repeat(np.array([h[1] for h in held], np.int64), [len(h[0]) for h in held])
            facts, sizes = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.uint64)
            held.clear()
            distinct, place, times = np.unique(keys, return_inverse=True, return_counts=True)
            often = times[place] >= FREQUENT_IN_TASK
            marks, one = distinct[times >= FREQUENT_IN_TASK], keys[~often]
            yield from _messages(
                (ASKED, key_bucket(one, width), one, own[~often], None),
                (MARK, key_bucket(marks, width), marks, None, None),
                (FACT, doc_bucket(facts, width), sizes, facts, None),
                (ANSWER, doc_bucket(own[often], width), keys[often], own[often], np.full(often.sum(), FREQUENT, np.int32)))

        for b in batches:
            for t in b.column(0):
                shingles = shingle_set(t.as_py(), size, table)
                if not len(shingles) or (node := names.both(shingles)[0]) in seen:
                    continue
                seen.add(node)  # copies within a stretch of input send one set of hashes
                sample = shingles[: int(bounds.sample(len(shingles)))]
                held.append((sample.copy(), node, len(shingles)))
                count += len(sample)
                if count >= 1_000_000:
                    yield from out()
                    count = 0
                    seen.clear()
        if held:
            yield from out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _received(batches)
        often = np.unique(found[MARK][0])
        for kind in (FACT, ANSWER):
            keys, own, counts = found.pop(kind)
            yield from _messages((kind, doc_bucket(own, width), keys, own, counts if kind == ANSWER else None))
        keys, own, _ = found.pop(ASKED)
        for lot in lots(keys, LOT):
            k, d = keys[lot], own[lot]
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            k, d = k[new], d[new]
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
            times = np.diff(np.append(starts, len(k)))
            times[np.isin(k[starts], often)] = FREQUENT
            times = np.repeat(times, np.diff(np.append(starts, len(k))))
            several = times > 1
            yield from _messages((ANSWER, doc_bucket(d[several], width), k[several], d[several], times[several].astype(np.int32)))

    return exchanged(docs.select("text").mapInArrow(released(send), _MESSAGE), width).mapInArrow(released(count), _MESSAGE)


PREFIXES = "node long, n long, digest binary, shared long, prefix array<long>"


def prefixes(docs: DataFrame, size: int, bounds: Bounds, names: Names) -> DataFrame:
    """Nodes that can have a partner: size, a digest of size and prefix, how many sampled hashes others have too, and
    the prefix of these, the rarest first (by count, then hash). Of n sampled hashes with a partner holding ``least`` of them,
    one of the first n - least + 1 is in common; those that no other set has come first and needn't be sent."""
    width = exchange_width(docs)
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("shared", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        found = _received(batches)
        sizes, nodes_, _ = found.pop(FACT)
        nodes_, first = np.unique(nodes_, return_index=True)
        sizes = sizes[first].astype(np.int64)
        keys, own, counts = found.pop(ANSWER)
        for lot in lots(own.view(np.uint64), LOT):
            k, d, c = keys[lot], own[lot], counts[lot]
            order = np.lexsort((k, c, d))
            k, d = k[order], d[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            k, d = k[new], d[new]
            if not len(d):
                continue
            starts = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            shared = np.diff(np.append(starts, len(d)))
            n = sizes[np.searchsorted(nodes_, d[starts])]
            least = np.array([*map(bounds.least, n.tolist())], np.int64)
            out, held = [], 0
            for i in np.flatnonzero(shared >= least).tolist():
                prefix = k[starts[i] : starts[i] + shared[i] - least[i] + 1]
                out.append((int(d[starts[i]]), int(n[i]), xxhash.xxh3_128_digest(prefix.tobytes() + int(n[i]).to_bytes(8, "little")), int(shared[i]), prefix.view(np.int64)))
                held += len(prefix)
                if held > 500_000:
                    yield batch_of(schema, [*map(list, zip(*out))])
                    out, held = [], 0
            if out:
                yield batch_of(schema, [*map(list, zip(*out))])

    return exchanged(counted(docs, size, bounds, names, width), width).mapInArrow(released(cut), PREFIXES)


def node_sets(docs: DataFrame, wanted: DataFrame, size: int, names: Names, bits: int = 1 << 25) -> DataFrame:
    """(node, n, parity bits, set as little-endian uint64): of each wanted node.

    A bitmap of ``bits`` bits, whatever the number of nodes, keeps most other sets from being sent; the join decides.
    """
    marks = wanted.selectExpr(f"cast(shiftright(pmod(node, {bits}), 5) as int) word", "shiftleft(1L, cast(pmod(node, 32) as int)) bit").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[marks.column(0).to_numpy()] = marks.column(1).to_numpy().astype(np.uint32)
    held = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([*((c, pa.int64()) for c in ("node", "n", *BITS)), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, out, filled = WordHashes(), set(), [], 0
        for b in batches:
            for t in b.column(0):
                shingles = shingle_set(t.as_py(), size, table)
                if not len(shingles) or (node := names.both(shingles)[0]) in seen or not held.value[(node % bits) >> 5] >> np.uint32(node % bits % 32) & 1:
                    continue
                seen.add(node)
                out.append((node, len(shingles), *parity_bits(shingles), shingles.tobytes()))
                filled += 8 * len(shingles)
                if filled > 16_000_000:
                    yield batch_of(schema, [*map(list, zip(*out))])
                    out, filled = [], 0
                    if len(seen) > 1_000_000:
                        seen.clear()
        if out:
            yield batch_of(schema, [*map(list, zip(*out))])

    return docs.select("text").mapInArrow(released(run), ", ".join(f"{c} long" for c in ("node", "n", *BITS)) + ", data binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose whole sets reach the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("data").alias("b_data")), "b").join(sets.select(F.col("node").alias("a"), F.col("data").alias("a_data")), "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch_of(schema, [a.filter(pa.array(ok, pa.bool_())), b.filter(pa.array(ok, pa.bool_()))])

    return both.select("a", "b", "a_data", "b_data").mapInArrow(released(run), "a long, b long")


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node that links lead to, for every node with a link.

    Each round takes the smallest label among a node and its neighbours, then the label of that label;
    rounds go on until no label changes. ``start`` has labels from fewer links. Every round is written to the shared folder.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node")
    if start is not None:
        labels = labels.join(start.withColumnRenamed("label", "known"), "node", "left").select("node", F.least("label", F.coalesce("known", "label")).alias("label"))
    labels = written(labels)
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        after = written(least.join(jump, "low", "left").select("node", F.least("low", F.coalesce("further", "low")).alias("new"), "label"))
        changed = after.where(F.col("new") != F.col("label")).limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


#: Pivots of the star rounds.
PIVOTS = (2, 8)
#: Nearest others that a unit is verified with in the rounds after these.
NEAREST = (2, 8)
#: Rows of a list that meet in one task, rows that a task holds before it compares, and pairs that it compares at once.
LIST_BLOCK, LIST_ROWS, LIST_PAIRS = 4096, 32_768, 1 << 19


def nearest(own: DataFrame, bounds: Bounds, most: int) -> DataFrame:
    """(a, b): of each unit in each list (node names the unit) the ``most`` units of other components that differ in the fewest bits, of those that leave room.

    Long lists meet block by block. Pairs stay within the task: what it returns grows with the rows of the lists.
    """
    words = [f"{c}_{x}" for c in ("all", "any") for x in BITS]
    size = own.groupBy("element").agg(F.ceil(F.count("*") / LIST_BLOCK).alias("blocks")).where("blocks > 1")
    dealt = own.join(size, "element", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["element", "low", "high"]
    rows = dealt.select("element", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label", "n", "rest", *words)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def closest(t: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: t.column(c).to_numpy() for c in t.column_names}
        own_bits, any_bits = (np.stack([col[f"{c}_{x}"] for x in BITS], 1) for c in ("all", "any"))
        new = np.any([col[k][1:] != col[k][:-1] for k in keys], axis=0)
        ends = np.append(np.flatnonzero(new) + 1, len(t))
        at = np.arange(len(t))
        others = np.repeat(ends, np.diff(np.append(0, ends))) - at - 1
        slack = bounds.sample(col["n"]) - col["n"]
        sums, start = np.cumsum(others), 0
        while start < len(t):
            done = sums[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sums, done + LIST_PAIRS, side="right")))
            times = others[start:end]
            i = np.repeat(at[start:end], times)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
            ok = (col["label"][i] != col["label"][j]) & ((col["low"][i] == col["high"][i]) | (col["block"][i] != col["block"][j]))
            i, j = i[ok], j[ok]
            both, t_ = col["n"][i] + col["n"][j], bounds.percent
            ok = 100 * np.minimum(col["n"][i], col["n"][j]) >= t_ * np.maximum(col["n"][i], col["n"][j])
            ok &= np.minimum(col["rest"][i], col["rest"][j]) >= np.minimum(slack[i], slack[j]) + (t_ * both + 99 + t_) // (100 + t_)
            i, j, both = i[ok], j[ok], both[ok]
            differ = np.bitwise_count((own_bits[i] & ~any_bits[j]) | (own_bits[j] & ~any_bits[i])).sum(axis=1, dtype=np.int64)
            ok = differ * (100 + t_) <= (100 - t_) * both
            i, j, differ = i[ok], j[ok], differ[ok]
            kept = np.zeros(len(i), bool)
            for side in (i, j):
                order = np.lexsort((differ, side))
                first = np.flatnonzero(np.append(True, side[order][1:] != side[order][:-1])) if len(i) else np.empty(0, np.int64)
                rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                kept[order[rank < most]] = True
            a, b = col["node"][i[kept]], col["node"][j[kept]]
            yield batch_of(schema, [np.minimum(a, b), np.maximum(a, b)])
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < LIST_ROWS:
                continue
            t = pa.Table.from_batches(held)
            last = [t.column(k).to_numpy() for k in keys]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in last], axis=0))
            if not len(cut):  # at most two blocks stand here
                continue
            whole = int(cut[-1]) + 1
            yield from closest(t.slice(0, whole))
            held = t.slice(whole).to_batches()
            count = len(t) - whole
        if count:
            yield from closest(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(run), "a long, b long")


def linked(docs: DataFrame, size: int, percent: int, names: Names, pivots: tuple[int, ...] = PIVOTS) -> DataFrame:
    """(node, label) of all nodes that have a link.

    Rounds over the groups: each member against its group's first; then, for each number of ``pivots``, in each list of groups that
    share a prefix element so many pivots against the groups that aren't in their components yet, so a group of copies costs a few
    pairs for each member; then, for each number in NEAREST, one member of each unit (those of a group that are in one component)
    against so many of the nearest units of other components, so links that would join the same two components again aren't looked for.
    What is still apart after that is verified group pair by group pair, each expanded to its
    members, except pairs verified before: no link between components is lost. Two groups meet once, at the first element they share
    among those of lists that are still apart, and only if the bits common to their members leave room. Members that size, position or
    the parity of 512 classes of elements tell apart don't become pairs; those of a list that are almost similar do.
    """
    spark: SparkSession = docs.sparkSession
    bounds = Bounds(percent)
    held = written(prefixes(docs, size, bounds, names))
    first = held.groupBy("digest").agg(F.min("node").alias("gid"))
    members = written(held.join(first, "digest").select("node", "gid", "n", "shared", "prefix"))
    elements = members.where("node = gid").select("gid", "n", "shared", F.posexplode("prefix").alias("place", "element")).select("gid", "n", (F.col("shared") - F.col("place")).alias("rest"), "element")
    several = elements.groupBy("element").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).where("low <> high").select("element")
    lists = written(elements.join(several, "element"))
    members = members.select("node", "gid")
    within = members.where("node <> gid")
    met = lists.select("gid").distinct()
    wanted = written(members.join(met, "gid", "left_semi").select("node").unionByName(within.select("node")).unionByName(within.select(F.col("gid").alias("node"))).distinct())
    sets = written(node_sets(docs, wanted, size, names))
    labels, links, tried = None, None, None

    def labelled(df: DataFrame, of: str) -> DataFrame:
        if labels is None:
            return df.withColumn("label", F.col(of))
        return df.join(labels.withColumnRenamed("node", of), of, "left").withColumn("label", F.coalesce("label", of))

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    room = bounds.may_reach("", "p_")
    facts = sets.select("node", "n", *BITS)
    for turn in range(len(pivots) + len(NEAREST) + 2):
        if not turn:
            pairs = within.select(*pair("gid", "node"))
        elif turn <= len(pivots):
            own = labelled(lists, "gid")
            row = ("gid", "label", "n", "rest")
            each = [F.min(F.struct(F.xxhash64("gid", F.lit(turn), F.lit(k)).alias("h"), *row)) for k in range(pivots[turn - 1])]
            split = own.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.array(*each).alias("pivots")).where("low <> high")
            other = split.select("element", F.explode(F.array_distinct(F.transform("pivots", lambda x: F.struct(*[x[c].alias(f"p_{c}") for c in row])))).alias("p")).select("element", "p.*")
            pairs = own.join(other, "element").where(F.col("label") != F.col("p_label")).where(room).select(*pair("gid", "p_gid"))
        else:
            units = written(labelled(members, "node").join(facts, "node"))
            parts = units.groupBy("gid", "label").agg(F.min("node").alias("node"), *(f(x).alias(f"{c}_{x}") for x in BITS for c, f in (("all", F.bit_and), ("any", F.bit_or))))
            own = lists.join(parts.select("gid", "label"), "gid")
            split = own.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("element")
            if turn <= len(pivots) + len(NEAREST):
                pairs = nearest(lists.join(split, "element", "left_semi").join(parts, "gid"), bounds, NEAREST[turn - len(pivots) - 1])
        if turn > len(pivots) + len(NEAREST):
            parts = parts.drop("node")
            left = lists.join(split, "element", "left_semi").groupBy("gid", "n").agg(F.sort_array(F.collect_list(F.struct("rest", "element")), False).alias("es"))
            each = left.select("gid", "n", F.posexplode("es").alias("at", "e"), F.col("es.element").alias("es")).select("gid", "n", "e.rest", "e.element", F.slice("es", F.lit(1), F.col("at")).alias("before"))
            own = written(each.join(parts, "gid"))
            other = own.select("element", *(F.col(c).alias(f"p_{c}") for c in own.columns if c != "element"))
            met = own.join(other, "element").where("gid < p_gid and label <> p_label").where(room).where(bounds.may_hold("", "p_")).where(~F.arrays_overlap("before", "p_before")).select("gid", "label", "p_gid", "p_label")
            bits = parts.join(units.select("gid", "label", "n").distinct(), ["gid", "label"])
            parts = parts.select("gid", "label")
            apart = parts.join(parts.select("gid", F.col("label").alias("p_label")), "gid").where("label < p_label").select("gid", "label", F.col("gid").alias("p_gid"), "p_label")
            both = met.unionByName(apart).distinct()
            theirs = units.select(*(F.col(c).alias(f"p_{c}") for c in units.columns))
            # members that the bits of the whole other unit exclude go before its members come in
            one = both.join(bits.select(*(F.col(c).alias(f"p_{c}") for c in bits.columns)), ["p_gid", "p_label"]).join(units, ["gid", "label"]).where(bounds.may_join("", "p_"))
            pairs = one.select("node", "n", *BITS, "p_gid", "p_label").join(theirs, ["p_gid", "p_label"]).where(bounds.may_match("", "p_")).select(*pair("node", "p_node"))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs)
        if not pairs.limit(1).count():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = written(verified(pairs, sets, percent))
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            labels = components(links, labels)
    if labels is None:
        return spark.createDataFrame([], "node long, label long")
    return labels


def labelled_rows(docs: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """(doc_id, row_key, n_shingles, node, label) of every row; label names the component, null for rows without words."""
    small_batches(docs.sparkSession)
    rows, names = named_rows(docs, size, bits)
    labels = linked(docs, size, percent, names)
    return rows.drop("proof").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def join(docs: DataFrame, size: int = 5, percent: int = 80, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every row.

    Two rows link when 100 * intersection >= percent * union of their sets. Null texts and texts without words have
    an empty set and link with nothing; shorter texts than a shingle are one element. Equal rows link with each other.
    A row without doc_id links others but never names a component unless alone (then null). Other columns are not read.
    Sets are told apart by 128 bits, shingles of two sets that are compared by 64 (a wrong match in about 1 of 10**12 pairs
    of 1,000 shingles).
    """
    rows = written(labelled_rows(docs, size, percent, bits))
    first = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(first, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, broadcast_rows: int = 1_000_000, bits: int = 64) -> DataFrame:
    """The rows of docs without near duplicates: of each component one row stays, of the smallest doc_id (rows without one come last).

    Rows are told apart by doc_id and text, so rows that share a doc_id are judged by their own texts; of rows that are
    equal in both one stays. Rows without words link with nothing and all stay. The keys of removed rows, and the components of
    several rows, are broadcast only up to ``broadcast_rows``.
    """
    rows = written(labelled_rows(docs, size, percent, bits).where("label is not null").select("doc_id", "row_key", "label"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    several = written(rows.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    out = rows.join(small(several), "label").where(order != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    again = rows.groupBy("doc_id", "row_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
    out, again = written(out), written(again)
    own = docs.withColumn("_own", F.xxhash64("doc_id", "text"))
    same = [F.col("_own") == F.col("_key"), F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))]
    kept = own.join(small(out), same, "left_anti")
    if not again.limit(1).count():
        return kept.select(docs.columns)
    repeated = kept.join(small(again), same, "left_semi").dropDuplicates(["_own", "doc_id"])
    return kept.join(small(again), same, "left_anti").unionByName(repeated).select(docs.columns)
