"""Language-model scoring: a gated recurrent network with a class-factored softmax, over counts of the whole corpus."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents, written
from tessera.llm.language_id import held_out

#: The end of a document as a token: no word is empty.
END = b""
LOG10 = float(np.log(10.0))


def slices(texts: pa.Array, most_bytes: int = 1 << 23):
    """(from, to) of slices of ``texts`` of about ``most_bytes`` at most, or of one text."""
    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(at):
        until = max(first + 1, int(np.searchsorted(at, (at[first - 1] if first else 0) + most_bytes, side="right")))
        yield first, until
        first = until


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of anything but space and U+0009 to U+000D, with A-Z in lower case, of all texts one after another, and how
    many each has. Arrow's ASCII functions know just this white space and these letters.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, real = parts.flatten(), pc.greater(pc.binary_length(parts.flatten()), 0)
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    edges = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)))
    return found.filter(real).cast(pa.binary()), np.diff(before[edges])


def count_words(docs: DataFrame, most_held: int = 400_000) -> DataFrame:
    """(token, c) over all of ``docs`` (text). A worker counts before anything is shuffled, and passes on what it has
    counted whenever it holds ``most_held`` tokens.
    """

    def counted(batches):
        held: Counter[bytes] = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
            held.clear()
            return made

        for batch in batches:
            for a, b in slices(batch.column(0)):
                found, _ = words(batch.column(0).slice(a, b - a))
                values, counts = pc.value_counts(found).flatten()
                for token, n in zip(values.to_numpy(zero_copy_only=False).tolist(), counts.to_numpy().tolist()):
                    held[token] += n
                held[END] += b - a
                if len(held) > most_held:
                    yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


WEIGHTS = ("table", "into", "shift", "gates", "change", "classes", "class_bias", "inner", "inner_bias")
#: Numbers of a softmax taken at once, so that they stay in the processor's cache and BLAS takes its kernels for small matrices.
CACHED = 60_000


@dataclass
class Network:
    """A gated recurrent unit. Token ids: words by falling count, then the unknown word, then the end.

    ``table`` has a vector for each token, ``into`` takes it to the three gates. The output goes to classes, and within
    a class to its words, which are the ids from ``edges[c]`` to ``edges[c + 1]``; the unknown word and the end are
    classes of one. ``sums`` are the squared slopes so far, one for each weight (see ``Fitter``).
    """

    edges: np.ndarray
    table: np.ndarray
    into: np.ndarray
    shift: np.ndarray
    gates: np.ndarray
    change: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    sums: dict[str, np.ndarray]

    @classmethod
    def new(cls, log_counts: np.ndarray, per_class: int, hidden: int, rng: np.random.Generator, unknown: float = 1.0, ends: float = 1.0) -> Network:
        """A network whose output starts from the counts. A class has ``per_class`` words in the mean; each has an equal
        share of the square roots of the counts, which keeps classes of frequent words small and the work on a token low.
        """
        n, counts = len(log_counts), np.exp(np.asarray(log_counts, np.float64))
        n_classes = -(-n // per_class)
        share = np.cumsum(np.sqrt(counts))
        kind = np.minimum((share / share[-1] * n_classes).astype(np.int64), n_classes - 1) if n else np.zeros(0, np.int64)
        edges = np.append(np.flatnonzero(np.diff(kind, prepend=-1)), n)
        mass = np.append(np.add.reduceat(counts, edges[:-1]) if n else [], [unknown, ends])
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        net = cls(
            edges, small(n + 2, hidden), rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32), np.zeros(3 * hidden, np.float32),
            small(hidden, 2 * hidden), small(hidden, hidden), small(hidden, len(mass)), np.log(mass / mass.sum()).astype(np.float32),
            small(n, hidden), np.asarray(log_counts, np.float32).copy(), {},
        )
        net.sums = {k: np.full_like(getattr(net, k), 1e-8) for k in WEIGHTS}
        return net

    @property
    def n_words(self) -> int:
        return len(self.inner)

    @property
    def unknown(self) -> int:
        return self.n_words

    @property
    def end(self) -> int:
        return self.n_words + 1

    @cached_property
    def kinds(self) -> np.ndarray:
        """The class of each id, in a type that numpy sorts by radix where it can."""
        sizes = np.append(np.diff(self.edges), [1, 1])
        return np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 1 << 16 else np.int64), sizes)

    def by_class(self, ids: np.ndarray):
        """An order of ``ids`` by class, their classes and places in it in that order, and runs (class, from, to) of all of
        them (for the softmax of classes) and of each class of several words, ``CACHED`` numbers of the softmax at most.
        """
        kind = self.kinds[ids]
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        place = ids[order] - np.append(self.edges, self.end)[kind]
        sizes, n = np.diff(self.edges), len(ids)
        edge = np.append(0, np.cumsum(np.bincount(kind, minlength=len(sizes))))

        def cut(c: int, a: int, b: int, width: int):
            rows = max(1, CACHED // width)
            return [(c, k, min(k + rows, b)) for k in range(a, b, rows)]

        words_of = [run for c, (a, b, width) in enumerate(zip(edge.tolist(), edge[1:].tolist(), sizes.tolist())) for run in cut(c, a, b, width)]
        return order, kind, place, cut(-1, 0, n, len(sizes) + 2), words_of

    def step(self, ids: np.ndarray, state: np.ndarray):
        """The next state of each row, and what is inside (see ``_turn``)."""
        room = np.empty((4 * state.shape[1], len(ids)), np.float32)
        return _turn((self.table[ids] @ self.into + self.shift).T, state.T, self.recurrent(), room).T, room

    def recurrent(self) -> np.ndarray:
        """What a state adds to the two gates and to the change, as one matrix from the left."""
        return np.ascontiguousarray(np.concatenate([self.gates, self.change], axis=1).T)

    def outputs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights of classes and of words, a row for each with its bias at the end, less the greatest of its softmax; and
        whether what ``states`` add to biases is so little that exponentials need no shift of their own.
        """
        inner_bias = self.inner_bias
        if len(self.edges) > 1:
            inner_bias = inner_bias - np.repeat(np.maximum.reduceat(inner_bias, self.edges[:-1]), np.diff(self.edges))
        classes = np.concatenate([self.classes, [self.class_bias - self.class_bias.max()]]).T
        inner = np.concatenate([self.inner, inner_bias[:, None]], axis=1)
        ones, most = np.ones(self.inner.shape[1], np.float32), max(1.0, float(np.abs(states).max(initial=0)))
        added = [(np.abs(w[:, :-1]) @ ones).max(initial=0) * most for w in (classes, inner)]
        return np.ascontiguousarray(classes), inner, max(added) < 60

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target; a word's is that of its class and, there, its own."""
        order, kind, place, all_runs, runs = self.by_class(targets)
        classes, inner, near = self.outputs(states)
        states = _with_ones(states.T, order)
        found = np.empty(len(order), np.float32)
        at, at_word = _flat(kind, all_runs), _flat(place, runs)
        for _, a, b in all_runs:
            found[a:b] = _log_shares(states[:, a:b], classes, at[a:b], near)
        for c, a, b in runs:
            found[a:b] += _log_shares(states[:, a:b], inner[self.edges[c] : self.edges[c + 1]], at_word[a:b], near)
        out = np.empty_like(found)
        out[order] = found
        return out

    def score(self, texts: list[np.ndarray], at_once: int = 1 << 16) -> np.ndarray:
        """Log10 probability of each whole sequence of ids. The longest come first, so that those still running are a
        prefix; the state goes on from one window of steps to the next until a sequence ends.
        """
        total, hidden, weights = np.zeros(len(texts)), len(self.change), self.recurrent()
        table, into = np.concatenate([self.table, np.ones((len(self.table), 1), np.float32)], axis=1), np.concatenate([self.into, [self.shift]]).T.copy()
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for first in range(0, len(order), 1 << 14):
            part = order[first : first + (1 << 14)]
            lengths = np.array([len(texts[i]) for i in part])
            tokens, starts = np.concatenate([texts[i] for i in part]), np.cumsum(lengths) - lengths
            state = np.zeros((hidden, len(part)), np.float32)
            before, at = np.full(len(part), self.end), 0
            while live := int((lengths > at).sum()):
                steps = max(1, min(at_once // live, int(lengths[0]) - at))
                lives = np.searchsorted(-lengths, -np.arange(at, at + steps))
                running = np.arange(live) < lives[:, None]
                window = tokens[np.minimum(starts[:live] + at + np.arange(steps)[:, None], len(tokens) - 1)]
                ends = np.cumsum(lives)
                states = np.empty((hidden, ends[-1]), np.float32)
                for target, m, end in zip(window, lives, ends):
                    state = _turn(into @ np.take(table, before[:m], axis=0).T, state[:, :m], weights, np.empty((4 * hidden, m), np.float32))
                    before = target[:m]
                    states[:, end - m : end] = state
                log_p = self.log_probabilities(states.T, window[running])
                total += np.bincount(np.broadcast_to(part[:live], running.shape)[running], log_p, len(total))
                at += steps
        return total / LOG10


def _turn(x: np.ndarray, state: np.ndarray, weights: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The next state, from what a token adds to the gates and from the weights of ``recurrent``. A column is a row's
    state, so that all of a gate lies together. ``room`` takes what the slopes need: keep, reset, past and new.
    """
    h = len(state)
    keep, reset, past, new = (room[k : k + h] for k in range(0, 4 * h, h))
    np.matmul(weights, state, out=room[: 3 * h])
    room[: 2 * h] += x[: 2 * h]
    _sigmoid(room[: 2 * h])
    np.multiply(reset, past, out=new)
    new += x[2 * h :]
    np.tanh(new, out=new)
    state = state - new
    state *= keep
    state += new
    return state


def _with_ones(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Columns of ``states`` in that order, and a row of ones that meets the biases."""
    made = np.ones((len(states) + 1, len(order)), np.float32)
    np.take(states, order, axis=1, out=made[:-1], mode="clip")
    return made


def _flat(place: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Where each target lies among the numbers of its run's softmax, a column for each target."""
    long = np.array([b - a for _, a, b in runs], np.int64)
    n = int(long.sum())
    return place[:n] * np.repeat(long, long) + np.arange(n) - np.repeat(np.cumsum(long) - long, long)


def _log_shares(states: np.ndarray, weights: np.ndarray, at: np.ndarray, near: bool) -> np.ndarray:
    z = weights @ states
    if not near:
        z -= z.max(axis=0)
    chosen = z.reshape(-1)[at]
    np.exp(z, out=z)
    chosen -= np.log(np.ones(len(z), np.float32) @ z)
    return chosen


class Fitter:
    """Truncated backpropagation through time: streams of whole documents, ``window`` steps at a time, the state carried
    from window to window and set to zero after a document's end. A weight's steps get shorter with the sum of its
    squared slopes (Adagrad); the sums go with the network. A token's row moves only in steps that have it.
    """

    def __init__(self, net: Network, window: int = 16, most_streams: int = 512):
        self.net, self.window, self.most_streams = net, window, most_streams

    def run(self, tokens: np.ndarray, rate) -> None:
        """One pass over all of ``tokens``, texts one after another; ``rate`` of the share that is done."""
        if not len(tokens):
            return
        streams = max(1, min(self.most_streams, len(tokens) // (100 * self.window)))
        length = len(tokens) // streams
        grid, rest = tokens[: length * streams].reshape(streams, length), tokens[length * streams :]
        for part, wide, step in ((grid, self.window, lambda at: rate(at / length)), (rest[None, :], max(1, len(rest)), lambda at: rate(1.0))):
            state = np.zeros((len(part), len(self.net.change)), np.float32)
            before = np.full(len(part), self.net.end)
            for at in range(0, part.shape[1], wide):
                target = part[:, at : at + wide]
                slope, seen, state = _slopes(self.net, before, state, target)
                self._move(slope, seen, step(at))
                before = target[:, -1]

    def _move(self, slope: dict[str, np.ndarray], seen: np.ndarray, rate: float) -> None:
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in slope.values()))
        clipped = np.float32(min(1.0, 5.0 / (norm + 1e-9)))
        for k, g in slope.items():
            if clipped < 1:
                g *= clipped
            rows = seen if k == "table" else slice(None)
            total = g * g
            total += self.net.sums[k][rows]
            self.net.sums[k][rows] = total
            g /= np.sqrt(total, out=total)
            g *= np.float32(rate)
            getattr(self.net, k)[rows] -= g


def flat(net: Network) -> np.ndarray:
    return np.concatenate([part[k].ravel() for part in (vars(net), net.sums) for k in WEIGHTS])


def with_weights(net: Network, values: np.ndarray) -> Network:
    """A network of the same shape that has ``values``, as ``flat`` puts them."""
    made, at = [], 0
    for part in (vars(net), net.sums):
        new = {}
        for k in WEIGHTS:
            new[k] = values[at : at + part[k].size].reshape(part[k].shape).copy()
            at += part[k].size
        made.append(new)
    return replace(net, **made[0], sums=made[1])


PIECES = "piece int, block int, n long, weights binary"


def train(ids: DataFrame, net: Network, n_blocks: int, passes: int, rate: float = 0.01, piece: int = 1 << 16, met: int = 128) -> Network:
    """``net`` trained on every row of ``ids`` (block, key, ids as int32 bytes), in rounds of 1, 2, 4, ... blocks, so that
    weights agree before many are averaged and the number of rounds grows with the logarithm of the blocks only.

    A block starts from the round's weights and goes through its rows in the order of ``key``, a batch of them at a
    time; the new weights are the mean of the blocks', weighed by tokens, taken piece by piece in Spark, ``met`` blocks
    at a time and then those means, and written to the shared folder. So the driver holds one set of weights, no task
    more than a piece of a few hundred, and the result hangs on no partitioning.
    """
    import pandas as pd

    spark = ids.sparkSession
    rounds, first = [], 0
    while first < n_blocks:
        n = min(1 << len(rounds), n_blocks - first)
        rounds.append((first, n))
        first += n
    for turn, (first, n) in enumerate([r for _ in range(passes) for r in rounds]):
        done, share = turn / (passes * len(rounds)), 1 / (passes * len(rounds))

        def learned(frames, net=net, done=done, share=share):
            block, tokens, fitter = None, 0, None

            def out():
                made = flat(fitter.net)
                at = range(0, len(made), piece)
                return pd.DataFrame({"piece": range(len(at)), "block": block, "n": tokens, "weights": [made[k : k + piece].tobytes() for k in at]})

            for frame in frames:
                for own, rows in frame.groupby("block", sort=True):
                    if own != block:
                        if fitter:
                            yield out()
                        block, tokens, fitter = own, 0, Fitter(with_weights(net, flat(net)))
                    run = np.frombuffer(b"".join(rows["ids"]), np.int32).astype(np.int64)
                    fitter.run(run, lambda x: rate * max(0.05, 1 - done - share * x))
                    tokens += len(run)
            if fitter:
                yield out()

        def mean(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("block")
            total = sum(np.frombuffer(w, np.float32).astype(np.float64) * k for w, k in zip(frame["weights"], frame["n"]))
            mean_of = (total / frame["n"].sum()).astype(np.float32).tobytes()
            return pd.DataFrame({"piece": frame["piece"].iloc[:1], "block": frame["block"].iloc[:1] // met, "n": int(frame["n"].sum()), "weights": [mean_of]})

        dealt = ids.where(F.col("block").between(first, first + n - 1)).repartition(n, "block").sortWithinPartitions("block", "key", "ids")
        made = dealt.select("block", "ids").mapInPandas(learned, PIECES)
        made = made.groupBy("piece", F.floor(F.col("block") / met).alias("group")).applyInPandas(mean, PIECES)
        made = written(made.groupBy("piece").applyInPandas(mean, PIECES), "weights").toPandas().sort_values("piece")
        if len(made):
            net = with_weights(net, np.frombuffer(b"".join(made["weights"]), np.float32))
    return net


def _slopes(net: Network, before: np.ndarray, state: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the mean loss of one window, the tokens whose rows of the table ``table`` has, and the state after it."""
    h, width, n = state.shape[1], target.shape[1], len(before)
    seen = np.ascontiguousarray(np.concatenate([before[:, None], target[:, :-1]], axis=1).T)
    vectors, weights = np.take(net.table, seen, axis=0), net.recurrent()
    adds = net.into.T @ vectors.transpose(0, 2, 1)
    adds += net.shift[:, None]
    goes_on = (seen != net.end).astype(np.float32)
    state, states = np.ascontiguousarray(state.T), np.empty((h, width, n), np.float32)
    pasts, inside = np.empty((width, h, n), np.float32), np.empty((width, 4 * h, n), np.float32)
    for t in range(width):
        np.multiply(state, goes_on[t], out=pasts[t])
        states[:, t] = state = _turn(adds[t], pasts[t], weights, inside[t])
    goal = target.T.ravel()
    order, kind, place, all_runs, runs = net.by_class(goal)
    classes, inner, near = net.outputs(states)
    chosen, at, at_word = _with_ones(states.reshape(h, -1), order), _flat(kind, all_runs), _flat(place, runs)
    share = np.float32(1.0 / max(1, len(goal)))
    back, of_classes, of_words = np.zeros((h, len(goal)), np.float32), np.zeros_like(classes), np.zeros_like(inner)
    total = np.ones(len(goal), np.float32)
    for _, a, b in all_runs:
        of_classes += _softmax_slopes(chosen[:, a:b], classes, at[a:b], near, total[a:b], back[:, a:b])
    back /= total
    back_words = np.zeros_like(back)
    for c, a, b in runs:
        own = slice(net.edges[c], net.edges[c + 1])
        of_words[own] += _softmax_slopes(chosen[:, a:b], inner[own], at_word[a:b], near, total[a:b], back_words[:, a:b])
    back_words /= total
    back += back_words
    for made in (back, of_classes, of_words):
        made *= share
    slope = {"classes": of_classes[:, :-1].T.copy(), "class_bias": of_classes[:, -1].copy()}
    slope |= {"inner": of_words[:, :-1].copy(), "inner_bias": of_words[:, -1].copy()}
    came = np.empty_like(order)
    came[order] = np.arange(len(order))
    down = np.take(back, came, axis=1).reshape(h, width, n)
    keep, reset, past, new = (inside[:, k : k + h] for k in range(0, 4 * h, h))
    # What a state's slope gives those of new, keep and reset before their squashing, and of past.
    parts = np.empty((width, 4, h, n), np.float32)
    parts[:, 0] = (1 - keep) * (1 - new * new)
    parts[:, 1] = (pasts - new) * keep * (1 - keep)
    np.multiply(parts[:, 0], reset, out=parts[:, 3])
    parts[:, 2] = parts[:, 3] * past * (1 - reset)
    carry, from_past = np.zeros_like(state), np.ascontiguousarray(weights.T)
    moved = parts.reshape(width, 4 * h, n)
    for t in range(width - 1, -1, -1):
        d = down[:, t]
        d += carry
        parts[t] *= d
        carry = from_past @ moved[t, h:]
        d *= keep[t]
        carry += d
        carry *= goes_on[t]
    recurrent = (pasts @ moved[:, h:].transpose(0, 2, 1)).sum(axis=0)
    slope["gates"], slope["change"] = recurrent[:, : 2 * h].copy(), recurrent[:, 2 * h :].copy()
    moved = moved[:, : 3 * h]
    slope["into"] = np.roll((vectors.transpose(0, 2, 1) @ moved.transpose(0, 2, 1)).sum(axis=0), -h, axis=1)
    slope["shift"] = np.roll(moved.sum(axis=2).sum(axis=0), -h)
    by_vector = (moved.transpose(0, 2, 1) @ np.roll(net.into, h, axis=1).T).reshape(-1, h)
    by_token = np.argsort(seen.ravel().astype(np.uint16 if net.end < 1 << 16 else np.int64), kind="stable")
    token = seen.ravel()[by_token]
    first = np.flatnonzero(np.diff(token, prepend=-1))
    slope["table"] = np.add.reduceat(np.take(by_vector, by_token, axis=0), first, axis=0)
    return slope, token[first], np.ascontiguousarray(state.T)


def _softmax_slopes(states: np.ndarray, weights: np.ndarray, at: np.ndarray, near: bool, total: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The slopes of the weights (biases at the end) of a softmax whose targets are ``at``. ``back`` takes the states'
    slopes times ``total``, and ``total`` the sums of exponentials.
    """
    z = weights @ states
    if not near:
        z -= z.max(axis=0)
    np.exp(z, out=z)
    np.matmul(np.ones(len(z), np.float32), z, out=total)
    z.reshape(-1)[at] -= total
    np.matmul(weights[:, :-1].T, z, out=back)
    return z @ (states / total).T


@dataclass
class Lexicon:
    """The frequent words, all with ``least`` or more in the counts; ``neural`` of them are the network's words."""

    tokens: list[bytes]
    counts: np.ndarray
    neural: int
    least: int


def frequent(counts: DataFrame, most: int, neural: int, neural_least: int) -> Lexicon:
    """The words from that count on from which there are at most ``most``: no more reach the driver or a worker. The
    network's are those of ``neural_least`` or more, at most ``neural``.
    """
    bins = F.floor(F.log2("c") * 8)
    tally = counts.where(F.length("token") > 0).groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect()
    total, least = 0, 1 << 62
    for row in sorted(tally, key=lambda r: -r["bin"]):
        total += row["n"]
        if total > most:
            break
        least = row["c"]
    rows = counts.where((F.length("token") > 0) & (F.col("c") >= least)).toPandas() if tally else None
    if rows is None or not len(rows):
        return Lexicon([], np.zeros(0, np.int64), 0, least)
    rows["token"] = rows["token"].map(bytes)
    rows = rows.sort_values(["c", "token"], ascending=[False, True])
    return Lexicon(rows["token"].tolist(), rows["c"].to_numpy(np.int64), min(neural, int((rows["c"] >= neural_least).sum())), least)


AS_IDS = (
    "uid long, doc_id long, held_out boolean, block int, key long, n_tokens long, n_known long, frequent_log double, unknown_log double,"
    " n_unknown long, rare array<binary>, ids binary"
)


def as_ids(rows: DataFrame, known: Lexicon, ends: int) -> DataFrame:
    """``rows`` (doc_id, held_out, block, key, text) with what the counts say of the text in place of the text: its ids in
    the network (int32 bytes, the last is the end), the logs of its frequent words and, to be joined, its rare words.
    """
    logs, end_log = np.log10(known.counts + 1.0), float(np.log10(ends + 1.0))
    unknown = known.neural
    names = [c.split()[0] for c in AS_IDS.split(", ")]

    def told(batches):
        from pyspark import TaskContext

        uid, frequent_words = TaskContext.get().partitionId() << 40, pa.array(known.tokens, pa.binary())
        for batch in batches:
            for a, b in slices(batch.column(4)):
                part = batch.slice(a, b - a)
                own, n = words(part.column(4))
                text = np.repeat(np.arange(b - a), n)
                at = pc.fill_null(pc.index_in(own, value_set=frequent_words), -1).to_numpy()
                rare, beyond = at < 0, at >= known.neural
                total = lambda of, weights=None: np.bincount(text[of], weights, b - a)
                n_rare, n_beyond = total(rare), total(beyond)
                frequent_log, unknown_log = total(~rare, logs[at[~rare]]) + end_log, total(beyond, logs[at[beyond]])
                ids, edges = np.full(len(at) + b - a, unknown + 1, np.int32), np.append(0, np.cumsum(n + 1))
                ids[np.arange(len(at)) + text] = np.where(rare | beyond, unknown, at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(uid, uid + b - a)), *part.columns[:4], pa.array(n + 1), pa.array(n - n_rare + (ends > 0)),
                    pa.array(frequent_log, pa.float64()), pa.array(unknown_log, pa.float64()), pa.array(n_rare + n_beyond),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)), pa.int32()), own.filter(pa.array(rare))),
                    pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(ids)]),
                ], names=names)
                uid += b - a

    return rows.mapInArrow(told, AS_IDS)


def score_documents(
    docs: DataFrame,
    is_held_out,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_frequent: int = 1 << 18,
    vocabulary: int = 1 << 14,
    per_class: int = 256,
    hidden: int = 16,
    epochs: int = 1,
    seed: int = 13,
    word_least: int = 8,
    block_tokens: int = 1 << 20,
    most_blocks: int = 1 << 16,
    rate: float = 0.2,
) -> DataFrame:
    """Log10 probability of every whole text, and that of the smoothed unigram counts (``base_score``).

    Counts are over all rows that aren't held out. The network knows the words counted ``word_least`` times or
    more, at most the ``vocabulary`` most frequent (a bound on memory), ordered into classes by frequency, an unknown
    word and the end of a document; its output starts from the log counts, and it is trained on all rows that aren't
    held out, ``epochs`` times. They are dealt by a hash of the id into blocks of about ``block_tokens`` tokens, which
    grow once there are ``most_blocks``; see ``train``. An unknown word
    has the network's probability of one, times its share (c + 1) of the smoothed counts outside of the vocabulary, so
    that the whole is a probability over all tokens. Texts run through the network whole, the state going on from
    window to window.

    Counts of frequent words (at most ``most_frequent``) go to all workers; rare words are joined to their counts, so
    no worker needs a table that grows. Null and empty texts are one end token. Without any training row all counts are
    0. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows that repeat are scored each,
    also those of one id with other texts or of a null id. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), is_held_out.alias("held_out"))
    counts = written(count_words(rows.where(~F.col("held_out"))), "word-counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.length("token") == 0, F.col("c"))).alias("ends")).first()
    n_train, distinct, ends = sums["n"] or 0, sums["v"], sums["ends"] or 0
    known = frequent(counts, most_frequent, vocabulary, word_least)
    whole = float(n_train + distinct + 1)
    neural = known.counts[: known.neural]
    outside = max(whole - float((neural + 1).sum()) - (ends + 1), 1.0)
    net = Network.new(np.log(neural + 1.0), per_class, hidden, np.random.default_rng(seed), max(1.0, n_train - ends - float(neural.sum())), ends + 1.0)
    n_blocks = int(min(max(1, n_train // block_tokens), most_blocks))
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_blocks)).cast("int")
    made = written(as_ids(rows.select("doc_id", "held_out", block, F.xxhash64("doc_id", F.lit(seed + 1)), "text"), known, ends), "ids")
    if n_train:
        net = train(made.where(~F.col("held_out")).select("block", "key", "ids"), net, n_blocks, epochs, rate=rate)
    net.sums = {}

    def scored(batches):
        for batch in batches:
            found = net.score([np.frombuffer(t.as_buffer(), np.int32) for t in batch.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), *batch.columns[1:]], names=["neural", *batch.schema.names[1:]])

    kept = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, frequent_log double, unknown_log double, n_unknown long"
    found = made.select("ids", *(c.split()[0] for c in kept.split(", "))).mapInArrow(scored, f"neural double, {kept}")
    rare = made.select("uid", F.explode("rare").alias("token")).join(counts.where(F.col("c") < known.least), "token", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_log"), F.count("c").alias("rare_known"))
    out = found.join(rare.withColumnRenamed("uid", "own"), F.col("uid") == F.col("own"), "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("frequent_log") + rare_log - F.col("n_tokens") * float(np.log10(whole))).alias("base_score"),
        (F.col("neural") + F.col("unknown_log") + rare_log - F.col("n_unknown") * float(np.log10(outside))).alias("score"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), held_out("doc_id", 7, 2))
