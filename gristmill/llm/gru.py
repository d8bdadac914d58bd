"""A gated recurrent language model in numpy, trained where the documents are, and document log-likelihoods."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, LONGEST_KEY, batch_of, released, small_batches, written
from .exchange import exchanged

#: The end of a document as a token; no word can hold its byte, which is a separator.
END = b"\n"


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def token_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(token, c) over all rows: words, and one END for each row; summed within each task before the shuffle."""
    schema = pa.schema([("token", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                held.update(tokens_of(t.as_py()))
                if len(held) >= most:
                    yield batch_of(schema, [[*held.keys()], [*held.values()]])
                    held.clear()
            held[END] += b.num_rows
        if held:
            yield batch_of(schema, [[*held.keys()], [*held.values()]])

    return docs.select("text").mapInArrow(released(run), "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The ``head`` most frequent tokens with their counts, of which the first ``model`` have outputs of their own."""

    tokens: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    model: int

    def __post_init__(self) -> None:
        self.rare_total = self.total - int(self.counts[: self.model].sum())
        self.rare_distinct = self.distinct - min(self.model, len(self.tokens))


def places_of(words: list[bytes], table: dict[bytes, int], other: int) -> np.ndarray:
    """Place of each word in the table; ``other`` for all that it doesn't hold, of which nothing is kept."""
    return np.fromiter(map(table.get, words, repeat(other)), np.int64, len(words))


class Network:
    """GRU with a class-factored softmax: P(word) = P(class | state) P(word | class, state).

    Classes are ``members`` consecutive frequency ranks; the last class is every rarer token. Parameters are one flat array.
    """

    def __init__(self, vocabulary: int, members: int, hidden: int):
        self.classes, self.members, self.hidden, self.words = -(-vocabulary // members), members, hidden, vocabulary
        shapes = {"x": (vocabulary + 1, 3 * hidden), "u": (hidden, 3 * hidden), "wc": (hidden, self.classes + 1), "bc": (self.classes + 1,), "wm": (self.classes, hidden, members), "bm": (self.classes, members)}
        sizes = [int(np.prod(s)) for s in shapes.values()]
        self.size = sum(sizes)
        self.cuts = [(n, s, e - z, e) for (n, s), z, e in zip(shapes.items(), sizes, np.cumsum(sizes).tolist())]
        self.dense = sizes[0]  # behind the inputs' rows, of which a window needs its own tokens' alone

    def views(self, flat: np.ndarray, start: int = 0) -> dict[str, np.ndarray]:
        """The parameters that lie from ``start`` on, of an array that begins there."""
        return {n: flat[s - start : e - start].reshape(shape) for n, shape, s, e in self.cuts if s >= start}

    def first(self, v: Vocabulary) -> np.ndarray:
        """Small random weights, and output biases at the corpus frequencies."""
        flat = (np.random.default_rng(11).standard_normal(self.size) * 0.1).astype(np.float32)
        p = self.views(flat)
        counts = np.zeros(self.classes * self.members)
        counts[: min(self.words, len(v.counts))] = v.counts[: self.words]
        by = counts.reshape(self.classes, self.members)
        each = np.append(by.sum(axis=1), v.rare_total) + 1
        p["bc"][:] = np.log(each / each.sum())
        p["bm"][:] = np.where(by > 0, np.log(np.maximum(by, 1e-9) / np.maximum(by.sum(axis=1, keepdims=True), 1)), -30)
        return flat

    @staticmethod
    def split(w: np.ndarray) -> np.ndarray:
        """(rows, 3 n) as (3, rows, n), so that each gate's values lie together; the first two negated, as ``cell`` needs their exp(-x)."""
        parts = np.ascontiguousarray(w.reshape(len(w), 3, -1).transpose(1, 0, 2))
        np.negative(parts[:2], out=parts[:2])
        return parts

    @staticmethod
    def cell(a: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from split inputs and weights: state after it, z (h - c), gates z and r, c, and the state's part of c. exp may overflow: that gate is 0."""
        s = np.matmul(h, u)
        zr = s[:2]
        zr += a[:2]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c = zr[1] * s[2]
        c += a[2]
        np.tanh(c, out=c)
        part = h - c
        part *= zr[0]
        return part + c, part, zr[0], zr[1], c, s[2]

    @classmethod
    def gates(cls, p: dict, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        with np.errstate(over="ignore"):
            return cls.cell(cls.split(p["x"].take(x, 0)), cls.split(p["u"]), h)

    @staticmethod
    def _softmax(logits: np.ndarray, at: np.ndarray, clip: bool, all_of_them: bool) -> np.ndarray:
        """Log probability of the targets; with ``all_of_them`` the logits become probabilities less 1 at the target."""
        if clip:
            np.clip(logits, -80, 80, out=logits)
        own = np.arange(len(at)) * logits.shape[1] + at
        found = logits.ravel()[own].astype(np.float64)
        e = np.exp(logits, out=logits)
        sums = e @ np.ones(e.shape[1], np.float32)
        if all_of_them:
            e *= (1 / sums)[:, None]
            e.ravel()[own] -= 1
        return found - np.log(sums)

    def outputs(self, p: dict, h: np.ndarray, y: np.ndarray, grads: dict | None = None, rows: int = 2048) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target's class and place in it (ids from ``words`` on: the rare class), and with ``grads`` the gradient by h.

        Targets are sorted by class and taken ``rows`` at a time, all classes of such a block in one softmax. States get a
        1 behind them, and weights their biases below them. States are below 1 and biases are log shares, so weights bound
        the logits; they are clipped only where that isn't enough.
        """
        n = h.shape[1]
        k = np.minimum(y // self.members, self.classes)
        k[y >= self.words] = self.classes
        order = np.argsort(k.astype(np.int16) if self.classes < 1 << 15 else k, kind="stable")
        k, place = k[order], y[order] - k[order] * self.members
        ends = np.searchsorted(k, np.arange(self.classes + 1))
        states = np.ones((len(y), n + 1), np.float32)
        states[:, :n] = h.take(order, 0)
        wc, wm = np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["wm"], p["bm"][:, None]], axis=1)
        clip = max(np.abs(w).sum(axis=-2).max() for w in (wc, wm)) > 80
        found, dh = np.empty(len(y)), None
        if grads is not None:
            dh = np.empty((len(y), n), np.float32)
        for lo in range(0, len(y), rows):
            own, most = states[lo : lo + rows], min(lo + rows, int(ends[-1])) - lo
            e = own @ wc
            found[lo : lo + rows] = self._softmax(e, k[lo : lo + rows], clip, grads is not None)
            if grads is not None:
                g = own.T @ e
                grads["wc"] += g[:n]
                grads["bc"] += g[n]
                np.matmul(e, p["wc"].T, out=dh[lo : lo + rows])
            if most <= 0:
                continue
            spans = [(c, max(0, int(ends[c]) - lo), min(most, int(ends[c + 1]) - lo)) for c in range(int(k[lo]), int(k[lo + most - 1]) + 1)]
            e = np.empty((most, self.members), np.float32)
            for c, a, b in spans:
                np.matmul(own[a:b], wm[c], out=e[a:b])
            found[lo : lo + most] += self._softmax(e, place[lo : lo + most], clip, grads is not None)
            if grads is not None:
                for c, a, b in spans:
                    g = own[a:b].T @ e[a:b]
                    grads["wm"][c] += g[:n]
                    grads["bm"][c] += g[n]
                    dh[lo + a : lo + b] += e[a:b] @ p["wm"][c].T
        back = np.empty(len(y))
        back[order] = found
        if grads is None:
            return back, None
        by = np.empty_like(dh)
        by[order] = dh
        return back, by


class Trainer:
    """Truncated backpropagation over parallel streams; the state is carried from window to window and reset behind END."""

    def __init__(self, net: Network, flat: np.ndarray, end: int, streams: int = 512, steps: int = 16, rate: float = 0.05):
        self.net, self.flat, self.end, self.streams, self.steps, self.rate = net, flat.copy(), end, streams, steps, rate
        self.square = np.full(net.size, 1e-6, np.float32)
        self.seen = 0

    def fit(self, ids: np.ndarray) -> None:
        """One pass over a run of token ids, documents one after the other. The run is laid out in rows of one length; what fills the last row up isn't learned."""
        width = max(1, min(self.streams, len(ids) // (2 * self.steps)))
        length = -(-len(ids) // width)
        fill = np.full(width * length - len(ids), -1, np.int64)
        y = np.concatenate([ids, fill]).reshape(width, length)
        x = np.concatenate([[self.end], ids, fill])[:-1].reshape(width, length)
        x[x < 0] = self.end
        h = np.zeros((width, self.net.hidden), np.float32)
        cut = self.net.dense
        inputs, squares = (self.net.views(w)["x"] for w in (self.flat, self.square))
        dense, dense_square = self.flat[cut:], self.square[cut:]
        for s in range(0, length, self.steps):
            rows, by_rows, rest, n, h = self.window(np.ascontiguousarray(x[:, s : s + self.steps].T), np.ascontiguousarray(y[:, s : s + self.steps].T), h)
            scale = 1 / max(1, n)
            norm = scale * float(np.sqrt(by_rows.ravel() @ by_rows.ravel() + rest @ rest))
            scale /= max(1, norm)
            by_rows *= scale
            rest *= scale
            square = squares.take(rows, 0)
            square += by_rows * by_rows
            squares[rows] = square
            by_rows *= self.rate
            inputs[rows] -= np.divide(by_rows, np.sqrt(square, out=square), out=by_rows)
            dense_square += rest * rest
            rest *= self.rate
            dense -= np.divide(rest, np.sqrt(dense_square), out=rest)
            self.seen += n

    def gradient(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """What window() finds, as one array of all parameters."""
        rows, by_rows, rest, n, h = self.window(x, y, h)
        grad = np.concatenate([np.zeros(self.net.dense, np.float32), rest])
        self.net.views(grad)["x"][rows] = by_rows
        return grad, n, h

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
        """Gradient of the negative log likelihood of a window (rows are time steps; targets under 0 don't count): the window's
        input ids, the gradient by their rows, that by all other parameters; its targets, and the state behind it."""
        net, n, (count, width) = self.net, self.net.hidden, x.shape
        p, rest = net.views(self.flat), np.zeros(net.size - net.dense, np.float32)
        g = net.views(rest, net.dense)
        flat_x = x.ravel().astype(np.int16 if net.words < (1 << 15) - 1 else np.int64)
        order = np.argsort(flat_x, kind="stable")
        new = np.append(True, np.diff(flat_x[order]) != 0)
        first = np.flatnonzero(new)
        rows, at = flat_x[order][first].astype(np.int64), np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        a, u = net.split(p["x"].take(rows, 0)).take(at, 1).reshape(3, count, width, n), net.split(p["u"])
        past, hs, states, ended = [], np.empty((count, width, n), np.float32), np.empty((count, width, n), np.float32), [np.flatnonzero(own == self.end) for own in x]
        with np.errstate(over="ignore"):
            for t in range(count):
                before = states[t]
                before[:] = h
                before[ended[t]] = 0
                h, part, z, r, c, un = net.cell(a[:, t], u, before)
                hs[t] = h
                rest_of_z = 1 - z
                part *= rest_of_z
                c *= c
                np.subtract(1, c, out=c)
                c *= rest_of_z
                un = un * r
                un *= 1 - r
                past.append((part, un, c, r, z))
        real = y.ravel() >= 0
        if real.all():
            dh = net.outputs(p, hs.reshape(-1, n), y.ravel(), g)[1].reshape(count, width, n)
        else:
            dh = np.zeros((count * width, n), np.float32)
            dh[real] = net.outputs(p, hs.reshape(-1, n)[real], y.ravel()[real], g)[1]
            dh = dh.reshape(count, width, n)
        # by the sums of z and r, of the state's part of c, and of the input's part of c
        by = np.empty((4, count, width, n), np.float32)
        carry, back = 0, np.ascontiguousarray(p["u"].reshape(n, 3, n).transpose(1, 2, 0))
        for t in reversed(range(count)):
            for_z, for_r, for_c, r, z = past[t]
            d = dh[t]
            d += carry
            dc = np.multiply(d, for_c, out=by[3, t])
            np.multiply(d, for_z, out=by[0, t])
            np.multiply(dc, for_r, out=by[1, t])
            np.multiply(dc, r, out=by[2, t])
            carry = d * z
            for more in np.matmul(by[:3, t], back):
                carry += more
            carry[ended[t]] = 0
        by = by.reshape(4, -1, n)
        g["u"][:] = np.matmul(states.reshape(-1, n).T, by[:3]).transpose(1, 0, 2).reshape(n, 3 * n)
        by_rows = np.concatenate([np.add.reduceat(by[i].take(order, 0), first) for i in (0, 1, 3)], axis=1)
        return rows, by_rows, rest, int(real.sum()), h


def score_documents(net: Network, flat: np.ndarray, docs: list[np.ndarray], end: int, rows: int = 16_384, width: int = 1024) -> np.ndarray:
    """Natural log probability of each document's model ids; ``width`` documents of about one length advance together, and the state goes from window to window."""
    p, back = net.views(flat), np.zeros(len(docs))
    inputs, u = net.split(p["x"]), net.split(p["u"])
    by_length = np.argsort([-len(d) for d in docs], kind="stable")
    for s in range(0, len(docs), width):
        order = by_length[s : s + width]
        total = np.zeros(len(order))
        lengths = np.array([len(docs[i]) for i in order])
        ids = np.concatenate([docs[i] for i in order])
        starts = np.cumsum(lengths) - lengths
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()
        h, x = np.zeros((len(order), net.hidden), np.float32), np.full(len(order), end, np.int64)
        hs, ys, ms, held = [], [], [], 0
        for t, m in enumerate(alive):
            with np.errstate(over="ignore"):
                h = net.cell(inputs.take(x[:m], 1), u, h[:m])[0]
            x = ids[starts[:m] + t].astype(np.int64)
            hs.append(h)
            ys.append(x)
            ms.append(m)
            held += m
            if held >= rows or t + 1 == len(alive):
                found, _ = net.outputs(p, np.concatenate(hs), np.concatenate(ys))
                total[: ms[0]] += np.bincount(np.concatenate([np.arange(k) for k in ms]), found, ms[0])
                hs, ys, ms, held = [], [], [], 0
        back[order] = total
    return back


def averaged(training: DataFrame, net: Network, flat: np.ndarray, v: Vocabulary, end: int, slices: int = 16, run_tokens: int = 400_000) -> np.ndarray:
    """Weights after every training document was trained on once, each task from ``flat`` on its own share.

    Tasks send slices of their weights times their tokens; a tree of two levels adds them slice by slice in a stream, so
    a task of it reads about the root of the number of tasks, and only one set of weights reaches the driver.
    """
    bounds = np.linspace(0, net.size, slices + 1).astype(int).tolist()
    fan = max(1, int(training.rdd.getNumPartitions() ** 0.5))
    schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("n", pa.int64()), ("w", pa.binary())])
    names = "bucket int, slice int, n long, w binary"

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, trainer = {w: i for i, w in enumerate(v.tokens[: v.model])}, Trainer(net, flat, end)
        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                ids = model_ids(tokens_of(t.as_py()), table, v.model, end)
                held.append(ids)
                size += len(ids)
                if size >= run_tokens:
                    trainer.fit(np.concatenate(held))
                    held, size = [], 0
        if held:
            trainer.fit(np.concatenate(held))
        if trainer.seen:
            weighted = trainer.flat.astype(np.float64) * (trainer.seen / 1e6)
            place = TaskContext.get().partitionId() % fan
            yield batch_of(schema, [[i * fan + place for i in range(slices)], [*range(slices)], [trainer.seen] * slices, [weighted[s:e].tobytes() for s, e in zip(bounds, bounds[1:])]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for _, i, n, w in zip(*(c.to_pylist() for c in b.columns)):
                held = sums.setdefault(i, [0, np.zeros(len(w) // 8)])
                held[0] += n
                held[1] += np.frombuffer(w)
        if sums:
            yield batch_of(schema, [[*sums], [*sums], [x[0] for x in sums.values()], [x[1].tobytes() for x in sums.values()]])

    sent = training.select("text").mapInArrow(released(train), names)
    some = exchanged(sent, slices * fan).mapInArrow(released(add), names)
    after = flat.copy()
    for r in exchanged(some, slices).mapInArrow(released(add), names).collect():
        after[bounds[r["slice"]] : bounds[r["slice"] + 1]] = np.frombuffer(r.w) * (1e6 / r.n)
    return after


def model_ids(words: list[bytes], table: dict[bytes, int], model: int, end: int) -> np.ndarray:
    """Ids of words and the end; words that the table of the model's words doesn't hold are the rare id."""
    return np.append(places_of(words, table, model), end)


def model_size(distinct: int) -> int:
    """Outputs of the model: they grow with the root of the distinct training tokens, twice that in steps of 256."""
    return 256 * max(1, round(2 * distinct**0.5 / 256))


def vocabulary(counts: DataFrame, head: int, model: int | None) -> tuple[Vocabulary, DataFrame]:
    """The most frequent tokens, and all others as (token, c).

    The head are the tokens of the highest classes of counts (16 to each doubling) that hold at most ``head`` tokens
    together, so nothing is sorted but the head; tokens of over LONGEST_KEY bytes are never in it, which bounds its bytes.
    """
    of = F.floor(16 * F.log2(F.col("c"))).cast("int")
    is_end = F.col("token") == F.lit(bytearray(END))
    fits = ~is_end & (F.octet_length("token") <= LONGEST_KEY)
    sizes = counts.groupBy(of.alias("class")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count(F.when(fits, 1)).alias("fit")).collect()
    total, distinct = sum(r.n for r in sizes), sum(r.v for r in sizes)
    least, room = 1 << 30, head - 1
    for r in sorted(sizes, key=lambda r: -r["class"]):
        if r.fit > room:
            break
        least, room = r["class"], room - r.fit
    rows = counts.where(fits & (of >= least)).select("token", "c").toArrow()
    found = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()), key=lambda r: (-r[1], r[0]))
    tokens, each = [r[0] for r in found], np.array([r[1] for r in found], np.int64)
    ends = counts.where(is_end).first()
    model = model_size(distinct) if model is None else model
    if ends is not None:  # the end has an output however few documents there are
        place = min(int(np.searchsorted(-each, -ends.c)), model - 1)
        tokens.insert(place, END)
        each = np.insert(each, place, ends.c)
    return Vocabulary(tokens, each, total, distinct, model), counts.where(~is_end & ~(fits & (of >= least))).select("token", "c")


PARTS = "doc_id long, held_out boolean, key long, n_tokens long, n_known long, n_tail long, base double, score double, tail array<binary>"


def likelihoods(docs: DataFrame, is_held_out: Column, hidden: int = 24, model: int | None = None, members: int | None = None, head: int = 262_144, warm_rows: int = 600, warm_chars: int = 20_000, run_tokens: int = 4_000_000) -> DataFrame:
    """Log10 probability of every whole text by the model and by add-one unigrams, both learned from the rows not held out.

    Counts cover all training rows. The model has outputs for the ``model`` most frequent tokens (none given: see model_size), in
    classes of ``members`` (none given: about the root of them); a rarer token gets the probability of the rare class times its
    add-one share of it. At most ``head`` tokens go to the tasks; counts of others are joined. Weights: a warm-up on
    ``warm_rows`` training rows of the smallest hash and at most ``warm_chars`` characters, then one pass over all training rows,
    whole, each task on its own, averaged by tokens.

    Null and empty texts are the end alone. Without training rows all counts are 0 and the model knows only the rare class.
    Rows are scored one by one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", is_held_out.alias("held_out"))
    training = rows.where(~F.coalesce("held_out", F.lit(False)))
    counts = written(token_counts(training))
    v, beyond = vocabulary(counts, head, model)
    model = v.model
    members = members or max(1, round(model**0.5))
    end = v.tokens.index(END) if END in v.tokens else model
    net = Network(model, members, hidden)
    flat = net.first(v)
    if v.total:
        # rows under a hash threshold of about twice the number, so that no task sends its own lowest rows; equal ones count once
        share = 2.0 * warm_rows / max(1, int(v.counts[end]) if end < len(v.tokens) else 1)
        low = training.where(F.length("text") <= warm_chars).select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.col("h") / 2.0**64 + 0.5 <= share)
        sample = sorted(low.dropDuplicates(["h"]).collect(), key=lambda r: r.h)[:warm_rows]
        table, trainer = {w: i for i, w in enumerate(v.tokens[:model])}, Trainer(net, flat, end, streams=32)
        runs = [model_ids(tokens_of(r.text), table, model, end) for r in sample]
        if runs:
            trainer.fit(np.concatenate(runs))
        flat = averaged(training, net, trainer.flat, v, end)
    logs, base_floor = np.log10(v.counts + 1.0), float(np.log10(v.total + v.distinct + 1))
    rare_floor = float(np.log10(v.rare_total + v.rare_distinct + 1))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_tail", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.binary()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, task, made = {w: i for i, w in enumerate(v.tokens)}, TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal made
            lp = score_documents(net, flat, [h[-1] for h in held], end) / np.log(10)
            keys = range(task + made, task + made + len(held))
            made += len(held)
            return batch_of(schema, [[h[0] for h in held], [h[1] for h in held], [*keys], [h[2] for h in held], [h[3] for h in held], [len(h[6]) for h in held], [h[4] for h in held], [h[5] + s for h, s in zip(held, lp.tolist())], [h[6] for h in held]])

        for b in batches:
            for doc, out_, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1)):
                words = tokens_of(t.as_py())
                places = places_of(words, table, -1)
                known, tail = places[places >= 0], [words[i] for i in np.flatnonzero(places < 0).tolist()]
                end_known = end < len(v.tokens)
                base = float(logs[known].sum()) + (float(logs[end]) if end_known else 0.0) - (len(words) + 1) * base_floor
                rare = known[known >= model]
                extra = float(logs[rare].sum()) - (len(rare) + len(tail) + (0 if end_known else 1)) * rare_floor
                ids = np.append(np.where((places < 0) | (places >= model), model, places), end).astype(np.int32)
                held.append((doc, out_, len(words) + 1, len(known) + bool(end_known), base, extra, tail, ids))
                size += len(ids)
                if size >= run_tokens:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    parts = written(rows.select("doc_id", "text", "held_out").mapInArrow(released(score), PARTS))
    asked = parts.select("key", F.explode("tail").alias("token"))
    sums = asked.join(beyond, "token").groupBy("key").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    both = parts.drop("tail").join(sums, "key", "left")
    log_sum = F.coalesce("logs", F.lit(0.0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + log_sum).alias("base_score"), (F.col("score") + log_sum).alias("score"))
