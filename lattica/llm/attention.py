"""Language-model scoring by a small causal self-attention model on subword ids, beside a base of smoothed word counts.

Words are counted over all training documents; the base score of a text comes from these counts. The model reads a text as subword
ids: each word, with a space before it, is cut by a public byte-level vocabulary, and one end token closes the document. Its direct path
from the present token are tables of pair counts over all training documents; to that path's logits one layer of causal self-attention with
relative positions, trained in numpy, adds what earlier tokens tell. Subwords beyond the HEAD - 1 most frequent share one class, in which a second
output of the layer chooses, worked out only where such a subword is met; those beyond its TAIL - 1 most frequent share one class of that, within
which their counts decide, so that every text has a probability. Either output chooses in two steps, a group of classes that are alike and then one of
the group, so that a position is held against few classes, while each class keeps weights of its own.

Texts longer than a window are read in overlapping ones: a window's first LEAD positions are context only, so each token is scored once.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import drop_staged, stage

#: Positions of a window, those that are scored, and the context before them.
WINDOW, STEP = 64, 48
LEAD = WINDOW - STEP
#: Output classes and those of the second output (the last is all rarer subwords), rows of the input table (likewise), width of the model.
HEAD, TAIL, ROWS, WIDTH = 256, 1024, 4096, 32
#: Classes of a group in the first output and in the second.
GROUP, TAIL_GROUP = 16, 32
GROUPS, TAIL_GROUPS = HEAD // GROUP, TAIL // TAIL_GROUP
#: Of a document's windows, one in EVERY is learnt from in each of ROUNDS rounds, so that all are; which come first goes by the document's ids.
EVERY, ROUNDS = 4, 4
#: Windows of a gradient step, and windows scored at once.
LEARN_AT_ONCE, SCORE_AT_ONCE = 32, 128
#: Frequent words of up to WORD_BYTES bytes whose counts go to every task; other words' counts are joined. A bound on cost, not on results.
FREQUENT, WORD_BYTES = 1 << 17, 32
#: Words, and bytes of words, that a task holds while it sums up or remembers.
HELD, HELD_BYTES = 400_000, 64 << 20
#: Characters of a word that are cut into subwords at once.
PIECE = 1024
#: Trained models that are averaged in one task, or by the driver.
MERGED = 16


def word_totals(texts: DataFrame) -> DataFrame:
    """text (binary, not null) -> (word binary, n): occurrences of every word, A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(text.as_py().lower().split())
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Cutter:
    """Cuts a word into subword ids. ranks: the vocabulary file's text; pattern: how a text falls into pieces."""

    ranks: str
    pattern: str

    def __post_init__(self):
        self.size = self.ranks.count("\n") + (not self.ranks.endswith("\n"))

    def open(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.ranks.splitlines())}
        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def end(self) -> int:
        return self.size

    @property
    def kind(self) -> str:
        """Of the numbers that ids are kept as."""
        return "<u2" if self.size < 1 << 16 else "<u4"

    @staticmethod
    def ids(encoding, word: bytes) -> list[int]:
        text = " " + word.decode("utf-8", "replace")
        return [i for k in range(0, len(text), PIECE) for i in encoding.encode_ordinary(text[k : k + PIECE])]


def subword_totals(words: DataFrame, cutter: Cutter) -> np.ndarray:
    """Occurrences of every subword id in words (word, n); at most a number for each id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, total = cutter.open(), np.zeros(cutter.size + 1, np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for i in cutter.ids(encoding, word.as_py()):
                    total[i] += n
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["id", "n"])

    out = np.zeros(cutter.size + 1, np.int64)
    for r in words.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


class _Words(dict):
    """word -> its number. Frequent words come cut and counted; another is cut on first use and has count -1."""

    def __init__(self, cutter: Cutter, frequent: tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]):
        self.encoding, self.frequent = cutter.open(), frequent
        self.forget()

    def forget(self) -> None:
        self.clear()
        words, counts, flat, start = self.frequent
        self.update(zip(words, range(len(words)), strict=True))
        self.bytes, self.word = 0, list(words)
        self.flat, self.start, self.count = array("I", flat.tobytes()), array("q", start.tobytes()), array("q", counts.tobytes())

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.word)
        self.flat.extend(Cutter.ids(self.encoding, word))
        self.start.append(len(self.flat))
        self.count.append(-1)
        self.word.append(word)
        self.bytes += len(word) + 200
        return n


def coded(docs: DataFrame, cutter: Cutter, frequent: dict[bytes, int]) -> DataFrame:
    """(id, held_out, text) -> (id, held_out, n_words, known, base, ids, rare): base sums up log10(count + 0.1) of the frequent words, rare has
    the others with their numbers, ids are of the cutter's kind."""
    encoding = cutter.open()
    cuts = [Cutter.ids(encoding, w) for w in frequent]
    start = np.cumsum([0, *map(len, cuts)])
    ready = (list(frequent), np.array(list(frequent.values()), np.int64), np.array([i for c in cuts for i in c], np.uint32), start.astype(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(ready)  # FREQUENT words of WORD_BYTES bytes at most
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words(cutter, shared.value)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                if memo.bytes > HELD_BYTES:
                    memo.forget()
                columns: list[list] = [[] for _ in range(5)]
                for text in part.column(2):
                    which = np.array(list(map(memo.__getitem__, text.as_py().lower().split())), np.int64)
                    count = np.frombuffer(memo.count, np.int64)[which] if len(which) else which
                    start = np.frombuffer(memo.start, np.int64)
                    size = start[which + 1] - start[which]
                    upto = np.cumsum(size)
                    place = np.repeat(start[which] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
                    ids = np.append(np.frombuffer(memo.flat, np.uint32)[place] if len(place) else place, cutter.end).astype(cutter.kind)
                    del start  # arrays grow again
                    often = count >= 0
                    rare, times = np.unique(which[~often], return_counts=True)
                    row = (len(which), int((count > 0).sum()), float(np.log10(count[often] + 0.1).sum()), ids.tobytes(), [{"word": memo.word[k], "n": n} for k, n in zip(rare.tolist(), times.tolist(), strict=True)])
                    del count
                    for c, x in zip(columns, row, strict=True):
                        c.append(x)
                made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.binary(), rare_type), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["id", "held_out", "n_words", "known", "base", "ids", "rare"])

    return docs.mapInArrow(run, "id long, held_out boolean, n_words long, known long, base double, ids binary, rare array<struct<word: binary, n: long>>")


#: Place of a class: its group in the first output or, from GROUPS on, in the second; the last place is that of no class (-1).
PLACES = GROUPS + TAIL_GROUPS + 1
_PLACE = np.concatenate([np.arange(HEAD - 1) // GROUP, GROUPS + np.arange(TAIL) // TAIL_GROUP, [PLACES - 1]]).astype(np.int8)


def alike(features: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which each `size` neighbours are alike: halved again and again along the direction in which they differ most."""

    def halved(rows: np.ndarray) -> np.ndarray:
        if len(rows) <= size:
            return rows
        x = features[rows] - features[rows].mean(axis=0)
        along = np.linalg.eigh(x @ x.T)[1][:, -1] if len(x) < x.shape[1] else x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        along *= np.sign(along[np.argmax(np.abs(along))])
        rows = rows[np.argsort(along, kind="stable")]
        return np.concatenate([halved(rows[: len(rows) // 2]), halved(rows[len(rows) // 2 :])])

    return halved(np.arange(len(features)))


class Vocabulary:
    """Input row of every subword, its class (from HEAD - 1 on: that of the second output) and the log share of a rarer one within its last class.
    The end token has row and class 0, until arrange() numbers the classes anew."""

    def __init__(self, totals: np.ndarray, cutter: Cutter, ends: int):
        end, self.kind = cutter.end, cutter.kind
        counts = totals.copy()
        counts[end] = 0
        order = np.argsort(-counts, kind="stable")
        order = np.append(end, order[order != end])
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(order))
        self.end = end
        self.row = np.minimum(rank, ROWS - 1).astype(np.int32)
        self.cls = np.minimum(rank, HEAD + TAIL - 2).astype(np.int32)
        counts[end] = ends
        last = self.cls == HEAD + TAIL - 2
        self.share = np.where(last, np.log(np.where(last, counts + 0.5, 1.0) / max((counts[last] + 0.5).sum(), 0.5)), 0.0)
        every = np.bincount(self.cls, counts, HEAD + TAIL - 1)
        self.of_class = np.append(every[: HEAD - 1], every[HEAD - 1 :].sum())
        self.within = np.log((every[HEAD - 1 :] + 0.5) / (every[HEAD - 1 :] + 0.5).sum()).astype(np.float32)

    def windows(self, ids: np.ndarray, some: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input rows (windows, WINDOW), classes and log shares (windows, STEP) of what is scored; class -1 where a window has no token. some: of which windows."""
        n = -(-len(ids) // STEP)
        pad = np.full(LEAD + n * STEP, self.end)
        pad[LEAD + 1 : LEAD + len(ids)] = ids[:-1]
        rows = self.row[np.lib.stride_tricks.sliding_window_view(pad, WINDOW)[::STEP][some]]
        own = np.full(n * STEP, self.end)
        own[: len(ids)] = ids
        own, none = own.reshape(n, STEP)[some], np.arange(n * STEP).reshape(n, STEP)[some] >= len(ids)
        cls, share = self.cls[own], self.share[own]
        cls[none], share[none] = -1, 0.0
        return rows, cls, share

    def arrange(self, pairs: np.ndarray) -> np.ndarray:
        """Numbers the classes of each output so that those of a group are alike in what comes before and after them; gives pair_totals' pairs in that order."""
        share = (self.of_class + 0.5) / (self.of_class + 0.5).sum()
        before, after = pairs.T + 1e-3, np.concatenate([pairs[: HEAD - 1], pairs[HEAD - 1 :].sum(axis=0, keepdims=True)])
        before /= before.sum(axis=1, keepdims=True)
        order = alike(np.sqrt(np.concatenate([before, np.exp(smoothed(after, share))], axis=1)), GROUP).reshape(GROUPS, GROUP)
        last = (order == HEAD - 1).any(axis=1)  # that class stays the last one
        own = order[last].ravel()
        order = np.concatenate([order[~last].ravel(), own[own != HEAD - 1], [HEAD - 1]])
        tail = alike(np.sqrt(np.exp(smoothed(pairs[HEAD - 1 : HEAD - 1 + TAIL], share))), TAIL_GROUP)
        number = np.empty(HEAD + TAIL - 1, np.int32)
        number[order[:-1]], number[HEAD - 1 + tail] = np.arange(HEAD - 1), HEAD - 1 + np.arange(TAIL)
        self.cls, self.of_class, self.within = number[self.cls], self.of_class[order], self.within[tail]
        return pairs[:, order]

    def places(self) -> np.ndarray:
        """Place of the class that every input row has; rows of rarer subwords, which have none of their own, have the last place."""
        out, known = np.full(ROWS, PLACES - 1), self.row < HEAD + TAIL - 2
        out[self.row[known]] = _PLACE[self.cls[known]]
        return out


def _cell_totals(texts: DataFrame, size: int, cells: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each of `size` cells is met over all texts (ids). `size` numbers at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                cell = cells(x.as_py())
                if len(cell) > 20_000:
                    total += np.bincount(cell, minlength=size)
                else:
                    np.add.at(total, cell, 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["cell", "n"])

    out = np.zeros(size, np.int64)
    found = texts.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def pair_totals(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """(ROWS, HEAD): how often a class follows an input row, over all texts (ids)."""

    def cells(text: bytes) -> np.ndarray:
        ids = np.frombuffer(text, vocabulary.kind)
        before = np.append(vocabulary.end, ids[:-1])
        return vocabulary.row[before].astype(np.int64) * HEAD + np.minimum(vocabulary.cls[ids], HEAD - 1)

    return _cell_totals(texts, ROWS * HEAD, cells).reshape(ROWS, HEAD)


def tail_totals(texts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ROWS, TAIL_GROUPS) and (PLACES, TAIL): how often a group of the second output follows an input row, and a class of it a place, over all texts (ids)."""
    place, groups = vocabulary.places(), ROWS * TAIL_GROUPS

    def cells(text: bytes) -> np.ndarray:
        ids = np.frombuffer(text, vocabulary.kind)
        cls = vocabulary.cls[ids].astype(np.int64) - (HEAD - 1)
        at = np.flatnonzero(cls >= 0)
        before, cls = vocabulary.row[np.append(vocabulary.end, ids[:-1])[at]].astype(np.int64), cls[at]
        return np.concatenate([before * TAIL_GROUPS + cls // TAIL_GROUP, groups + place[before] * TAIL + cls])

    found = _cell_totals(texts, groups + PLACES * TAIL, cells)
    return found[:groups].reshape(ROWS, TAIL_GROUPS), found[groups:].reshape(PLACES, TAIL)


def smoothed(counts: np.ndarray, share: np.ndarray, prior: float = 20.0) -> np.ndarray:
    """Log of the counts' shares along the last axis, as if `prior` more had come by the shares given."""
    return np.log((counts + prior * share) / (counts.sum(axis=-1, keepdims=True) + prior)).astype(np.float32)


def direct_path(pairs: np.ndarray, of_class: np.ndarray, prior: float = 20.0) -> np.ndarray:
    """Log probability of each class after each input row, smoothed towards the classes' own shares."""
    return smoothed(pairs, (of_class + 0.5) / (of_class + 0.5).sum(), prior)


class Rarer:
    """The second output's direct path: log probability of each of its groups after each input row, and of each class in its group after the place of the row before."""

    def __init__(self, within: np.ndarray, after: np.ndarray | None = None, inner: np.ndarray | None = None, place: np.ndarray | None = None):
        share = np.exp(within.astype(float)).reshape(TAIL_GROUPS, TAIL_GROUP)
        of_group = share.sum(axis=1)
        self.place = np.zeros(ROWS, np.int64) if place is None else place
        self.of_group = smoothed(np.zeros((ROWS, TAIL_GROUPS)) if after is None else after, of_group)
        counts = np.zeros((1, TAIL)) if inner is None else inner
        self.in_group = smoothed(counts.reshape(-1, TAIL_GROUPS, TAIL_GROUP), share / of_group[:, None]).reshape(-1, TAIL_GROUP)


def _exps(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of logits, by rows, and the rows' sums. Rows are brought in reach of exp only where one isn't: their largest is then taken off the logits."""
    ones = np.ones(logits.shape[-1], logits.dtype)
    with np.errstate(over="ignore"):
        e = np.exp(logits)
        total = e @ ones
    if total.size and not 1e-30 < total.min() <= total.max() < 1e30:
        logits -= logits.max(axis=-1, keepdims=True)
        e = np.exp(logits)
        total = e @ ones
    return e, total


class _Output:
    """The choice of a class at some positions, in two steps: of its group, and within it. spans: group, and from and up to which position, in the order of positions."""

    def __init__(self, h: np.ndarray, first: np.ndarray, second: np.ndarray, spans: list[tuple[int, int, int]], groups: np.ndarray, within: np.ndarray):
        self.h, self.first, self.second, self.spans, self.chosen = h, first, second, spans, (groups, within)
        own = np.empty((len(h), second.shape[2]), h.dtype)
        for k, a, b in spans:
            np.dot(h[a:b], second[k], out=own[a:b])
        self.logits = h @ first, own

    def log_probability(self) -> np.ndarray:
        """Natural log probability of what was chosen."""
        self.exps, found = [], 0.0
        for x, chosen in zip(self.logits, self.chosen, strict=True):
            e, total = _exps(x)
            self.exps.append((e, total))
            found = found + x[np.arange(len(x)), chosen].astype(float) - np.log(total)
        return found

    def slopes(self, each: np.float32, of_first: np.ndarray, of_second: np.ndarray) -> np.ndarray:
        """After log_probability: of its negative sum times each, by h; those by the weights go to of_first and of_second."""
        for (e, total), chosen in zip(self.exps, self.chosen, strict=True):
            e *= (each / total)[:, None]
            e[np.arange(len(e)), chosen] -= each
        top, own = (e for e, _ in self.exps)
        of_first[:], of_second[:] = self.h.T @ top, 0
        out, turned = np.empty_like(self.h), self.h.T
        for k, a, b in self.spans:
            of_second[k] = np.dot(turned[:, a:b], own[a:b])
            np.dot(own[a:b], self.second[k].T, out=out[a:b])
        out += top @ self.first.T
        return out


class Model:
    """One layer of causal self-attention on top of the direct path. Weights are one flat array, so that models can be averaged.

    The direct path is split into the outputs' two steps, so that without the layer the probabilities are the pair counts'. Products of two weight matrices are made before
    positions meet them: (x q)(y k)' is x (q k') y', and (a (x v)) w is (a x)(v w).
    """

    SHAPES = {"e": (ROWS, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "r": (WINDOW,), "w1": (2 * WIDTH, WIDTH), "b1": (WIDTH,), "g2": (WIDTH, GROUPS), "w2": (GROUPS, WIDTH, GROUP), "g3": (WIDTH, TAIL_GROUPS), "w3": (TAIL_GROUPS, WIDTH, TAIL_GROUP)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, direct: np.ndarray, within: np.ndarray, weights: np.ndarray | None = None, seed: int = 13, rarer: Rarer | None = None):
        if weights is None:
            rng, parts = np.random.default_rng(seed), []
            for name, shape in self.SHAPES.items():
                spread = {"e": 0.3, "g2": 0.02, "w2": 0.02, "g3": 0.02, "w3": 0.02, "r": 0.0, "b1": 0.0}.get(name, 1 / np.sqrt(shape[0]))
                parts.append((rng.standard_normal(shape) * spread).ravel())
            weights = np.concatenate(parts)
        self.direct, self.weights = direct, np.array(weights, np.float32)
        self.__dict__.update(self.named(self.weights))
        by_group = direct.reshape(ROWS, GROUPS, GROUP)
        self.of_group = np.log(np.exp(by_group).sum(axis=2))
        self.in_group = (by_group - self.of_group[:, :, None]).reshape(-1, GROUP)
        self.rarer = rarer or Rarer(within)
        ago = np.arange(LEAD, WINDOW)[:, None] - np.arange(WINDOW)[None]
        self.ago = np.maximum(ago, 0)
        self.causal = (ago >= 0).astype(np.float32)
        self.slope = np.zeros(self.SIZE, np.float32)
        self.slopes = self.named(self.slope)
        self.met = np.zeros(0, np.int16)  # rows that the last slope is about

    @classmethod
    def named(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of one flat array by the weights' names."""
        ends = np.cumsum([int(np.prod(s)) for s in cls.SHAPES.values()])
        return {name: part.reshape(shape) for (name, shape), part in zip(cls.SHAPES.items(), np.split(flat, ends[:-1]), strict=True)}

    def products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a query, a position itself, and a position that is attended to are multiplied by."""
        return (self.q @ self.k.T) * np.float32(WIDTH**-0.5), self.w1[:WIDTH], self.v @ self.w1[WIDTH:]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The products for every input row. They go with the weights as they are now."""
        queries, own, attended = self.products()
        return self.e @ queries, self.e @ own + self.b1, self.e @ attended

    def attention(self, q: np.ndarray, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Fills a (windows, STEP, WINDOW), the weights of the positions for each scored one before they are divided by their sums; gives one over the sums."""
        ones = np.ones((WINDOW, 1), a.dtype)
        np.matmul(q, x.transpose(0, 2, 1), out=a)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(a, out=a)
            a *= np.exp(self.r[self.ago]) * self.causal
            total = a @ ones
        if total.size and not 1e-30 < total.min() <= total.max() < 1e30:  # out of reach of exp: once more, with the largest taken off
            np.matmul(q, x.transpose(0, 2, 1), out=a)
            a += np.where(self.causal > 0, self.r[self.ago], -np.inf)
            a -= a.max(axis=2, keepdims=True)
            np.exp(a, out=a)
            total = a @ ones
        return 1 / total.reshape(-1, 1)

    def outputs(self, h: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, int, _Output, _Output]:
        """The positions that have a class, in the order of its place; from which of them on the second output is met; both outputs there."""
        place = _PLACE[cls]
        ends = np.cumsum(np.bincount(place, minlength=GROUPS + TAIL_GROUPS + 1)).tolist()
        order = np.argsort(place, kind="stable")[: ends[-2]]
        h, rows, cls, group = h[order], rows[order], cls[order], np.minimum(place[order], GROUPS - 1)
        bounds = [0, *ends[: GROUPS - 1], ends[-2]]
        head = _Output(h, self.g2, self.w2, [(k, a, b) for k, (a, b) in enumerate(pairwise(bounds)) if a < b], group, np.minimum(cls, HEAD - 1) % GROUP)
        for x, more in zip(head.logits, (self.of_group[rows], self.in_group[rows * GROUPS + group]), strict=True):
            x += more
        met = ends[GROUPS - 1]
        group, within = np.divmod(cls[met:] - (HEAD - 1), TAIL_GROUP)
        bounds = [e - met for e in ends[GROUPS - 1 : -1]]
        tail = _Output(h[met:], self.g3, self.w3, [(k, a, b) for k, (a, b) in enumerate(pairwise(bounds)) if a < b], group, within)
        for x, more in zip(tail.logits, (self.rarer.of_group[rows[met:]], self.rarer.in_group[self.rarer.place[rows[met:]] * TAIL_GROUPS + group]), strict=True):
            x += more
        return order, met, head, tail

    def log_probability(self, rows: np.ndarray, cls: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Natural log probability of the classes at the scored positions; 0 where the class is -1. tables: where these were made before."""
        queries, own, attended = tables or self.tables()
        late = rows[:, LEAD:].ravel()
        a = np.empty((len(rows), STEP, WINDOW), queries.dtype)
        over = self.attention(queries[late].reshape(-1, STEP, WIDTH), self.e[rows], a)
        h = (a @ attended[rows]).reshape(-1, WIDTH)
        h *= over
        h += own[late]
        np.maximum(h, 0, out=h)
        order, met, head, tail = self.outputs(h, late, cls.ravel())
        out, found = np.zeros(cls.size), head.log_probability()
        found[met:] += tail.log_probability()
        out[order] = found
        return out.reshape(cls.shape)

    def gradient(self, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Of the mean negative log probability of the scored positions. The array is the model's own; the next call fills it anew."""
        queries, own, attended = self.products()
        x, g = self.e[rows], self.slopes
        late, both = x[:, LEAD:].reshape(-1, WIDTH), np.concatenate([queries, own], axis=1)
        z = late @ both
        q = z.reshape(-1, STEP, 2 * WIDTH)[:, :, :WIDTH]
        weights, sides = np.empty((len(x), 2 * STEP, WINDOW), x.dtype), np.empty((len(x), 2 * STEP, WIDTH), x.dtype)
        a, ds = weights[:, :STEP], weights[:, STEP:]
        over = self.attention(q, x, a)
        c = (a @ x).reshape(-1, WIDTH)
        c *= over
        h = c @ attended
        h += z[:, WIDTH:]
        h += self.b1
        np.maximum(h, 0, out=h)

        order, met, head, tail = self.outputs(h, rows[:, LEAD:].ravel(), cls.ravel())
        each = np.float32(1 / max(len(order), 1))
        head.log_probability()
        tail.log_probability()
        d = head.slopes(each, g["g2"], g["w2"])
        d[met:] += tail.slopes(each, g["g3"], g["w3"])
        d *= head.h > 0
        dz = np.zeros_like(z)
        dh = dz[:, WIDTH:]
        dh[order] = d

        g["b1"][:] = np.ones(len(dh), dh.dtype) @ dh
        of_attended = c.T @ dh
        dc = dh @ attended.T
        less = (dc * c) @ np.ones((WIDTH, 1), dc.dtype)  # as large as the sum of slopes by a, times a
        less *= over
        dc *= over
        dc = dc.reshape(-1, STEP, WIDTH)
        np.matmul(dc, x.transpose(0, 2, 1), out=ds)
        ds -= less.reshape(-1, STEP, 1)
        ds *= a
        g["r"][:] = np.bincount(self.ago.ravel(), ds.sum(axis=0).ravel(), WINDOW)
        dz.reshape(-1, STEP, 2 * WIDTH)[:, :, :WIDTH] = ds @ x
        sides[:, :STEP], sides[:, STEP:] = dc, q
        dx = weights.transpose(0, 2, 1) @ sides
        dx[:, LEAD:] += (dz @ both.T).reshape(-1, STEP, WIDTH)
        of_both = late.T @ dz
        of_queries = of_both[:, :WIDTH] * np.float32(WIDTH**-0.5)
        g["q"][:], g["k"][:] = of_queries @ self.k, of_queries.T @ self.q
        g["w1"][:WIDTH], g["w1"][WIDTH:], g["v"][:] = of_both[:, WIDTH:], self.v.T @ of_attended, of_attended @ self.w1[WIDTH:].T

        flat = rows.ravel().astype(np.int16)  # sorted by digits
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        g["e"][self.met] = 0
        self.met = flat[start]
        g["e"][self.met] = np.add.reduceat(dx.reshape(-1, WIDTH)[order], start, axis=0)
        return self.slope


class Adam:
    """Steps along running means of gradients over the root of their squares'. Kept are the sums that decay, not yet times 0.1 and 0.01. Rows of the input table that no window
    of a step has keep their weights and sums."""

    def __init__(self, rate: float = 5e-3):
        self.rate, self.t = rate, 0
        self.m, self.s = Model.named(np.zeros(Model.SIZE, np.float32)), Model.named(np.zeros(Model.SIZE, np.float32))

    def step(self, model: Model) -> None:
        self.t += 1
        root = np.sqrt(0.01 / (1 - 0.99**self.t))
        rate, least = np.float32(self.rate * 0.1 / (1 - 0.9**self.t) / root), np.float32(1e-7 / root)
        for name, g in model.slopes.items():
            w, m, s = getattr(model, name), self.m[name], self.s[name]
            if name == "e":
                every, g = (w, m, s), g[model.met]
                w, m, s = (np.take(x, model.met, axis=0) for x in every)
            m *= np.float32(0.9)
            m += g
            s *= np.float32(0.99)
            s += g * g
            by = np.sqrt(s)
            by += least
            np.divide(m, by, out=by)
            by *= rate
            w -= by
            if name == "e":
                for x, new in zip(every, (w, m, s), strict=True):
                    x[model.met] = new


def windows_of_round(ids: bytes, r: int, rounds: int = ROUNDS, every: int = EVERY) -> slice:
    """Which of a document's windows are learnt from in round r. With at least `every` rounds, each window is in one of them."""
    return slice((zlib.crc32(ids) + r * every // rounds) % every, None, every)


def trained(texts: DataFrame, vocabulary: Vocabulary, direct: np.ndarray, rounds: int = ROUNDS, every: int = EVERY, rarer: Rarer | None = None) -> Model:
    """A model that has learnt from every window of texts (ids). In each round, every task steps through its windows from the same weights, and the tasks' weights
    are averaged by their numbers of windows, MERGED at a time, so that neither a task nor the driver holds more."""
    if rounds < every:
        raise ValueError(f"{rounds} rounds with one window in {every} leave windows out")
    weights = Model(direct, vocabulary.within, rarer=rarer).weights

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(Model.SIZE), 0
        for batch in batches:
            for w, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total += k * np.frombuffer(w.as_py(), np.float32)
                n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([n])], names=["weights", "n"])

    for r in range(rounds):

        def learn(batches: Iterator[pa.RecordBatch], r: int = r, weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            model, adam, n = Model(direct, vocabulary.within, weights, rarer=rarer), Adam(), 0
            rows, cls, waiting = [], [], 0
            for batch in batches:
                for x in batch.column(0):
                    raw = x.as_py()
                    some = windows_of_round(raw, r, rounds, every)
                    ids = np.frombuffer(raw, vocabulary.kind)
                    if some.start * STEP >= len(ids):
                        continue
                    a, c, _ = vocabulary.windows(ids, some)
                    rows.append(a)
                    cls.append(c)
                    waiting += len(a)
                    while waiting >= LEARN_AT_ONCE:
                        a, c = np.concatenate(rows), np.concatenate(cls)
                        model.gradient(a[:LEARN_AT_ONCE], c[:LEARN_AT_ONCE])
                        adam.step(model)
                        n += LEARN_AT_ONCE
                        rows, cls, waiting = [a[LEARN_AT_ONCE:]], [c[LEARN_AT_ONCE:]], waiting - LEARN_AT_ONCE
            if waiting:
                model.gradient(np.concatenate(rows), np.concatenate(cls))
                adam.step(model)
                n += waiting
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([n])], names=["weights", "n"])

        parts = stage(texts.select("ids").mapInArrow(learn, "weights binary, n long"), compression="uncompressed")
        while (many := parts.count()) > MERGED:
            fewer = stage(parts.repartition(-(-many // MERGED)).mapInArrow(mean, "weights binary, n long"), compression="uncompressed")
            drop_staged(parts)
            parts = fewer
        found = parts.collect()
        drop_staged(parts)
        if found:
            n = sum(p["n"] for p in found)
            weights = (sum(p["n"] * np.frombuffer(p["weights"], np.float32).astype(float) for p in found) / n).astype(np.float32)
    return Model(direct, vocabulary.within, weights, rarer=rarer)


def scored(texts: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """coded()'s rows without ids, with `score`: the model's log10 probability of the ids."""
    direct, weights, rarer = model.direct, model.weights, model.rarer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(direct, vocabulary.within, weights, rarer=rarer)
        tables = model.tables()
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for part in (batch.slice(k, 256) for k in range(0, len(batch), 256)):
                score, waiting, held = np.zeros(len(part)), [], 0

                def work() -> None:
                    rows, cls, share, of = (np.concatenate(c) for c in zip(*waiting, strict=True))
                    for k in range(0, len(rows), SCORE_AT_ONCE):
                        some = slice(k, k + SCORE_AT_ONCE)
                        np.add.at(score, of[some], (model.log_probability(rows[some], cls[some], tables) + share[some]).sum(axis=1))

                for k, x in enumerate(part.column(at)):
                    found = vocabulary.windows(np.frombuffer(x.as_py(), vocabulary.kind))
                    waiting.append((*found, np.full(len(found[0]), k)))
                    held += len(found[0])
                    if held >= 8 * SCORE_AT_ONCE:
                        work()
                        waiting, held = [], 0
                if waiting:
                    work()
                rest = [c for n, c in enumerate(part.columns) if n != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score / np.log(10))], names=[*(n for n in part.schema.names if n != "ids"), "score"])

    return texts.mapInArrow(run, "id long, held_out boolean, n_words long, known long, base double, rare array<struct<word: binary, n: long>>, score double")


def score_texts(docs: DataFrame, held_out: Column, cutter: Cutter, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, rounds: int = ROUNDS, frequent_words: int = FREQUENT) -> DataFrame:
    """One row per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out (a null in held_out counts as not). Tokens are words, A-Z lower-cased, and one end. base_score: sum over tokens of
    log10((c + 0.1) / (N + 0.1 * (V + 1))) with the training tokens' counts c, their number N and variety V. score: the model's log10 probability of the words in order, then the
    end. A null text is empty: one token. Bytes that are no UTF-8 are read as U+FFFD by the model. Rows with equal or null ids are scored each for itself; equal
    texts get scores that are equal but for rounding (parts in 10^7). Nothing to learn from leaves N = V = 0 and a model without counts. Other columns are left out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text)
    training = plain.where("not held_out")
    words = stage(word_totals(training.select("text")))
    ends = training.count()
    v, n = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = n + ends, v + (ends > 0)
    often = words.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.col("n").desc(), "word").limit(frequent_words).toArrow()
    frequent = dict(zip(often.column(0).to_pylist(), often.column(1).to_pylist(), strict=True))

    vocabulary = Vocabulary(subword_totals(words, cutter), cutter, ends)
    texts = stage(coded(plain, cutter, frequent))
    learnt = texts.where("not held_out")
    pairs = vocabulary.arrange(pair_totals(learnt, vocabulary))
    direct, rarer = direct_path(pairs, vocabulary.of_class), Rarer(vocabulary.within, *tail_totals(learnt, vocabulary), vocabulary.places())
    model = trained(learnt, vocabulary, direct, rounds, every, rarer)
    done = stage(scored(texts, vocabulary, model).withColumn("key", F.monotonically_increasing_id()))  # kept by writing it
    drop_staged(texts)

    rare = done.select("key", F.explode("rare").alias("w")).select("key", "w.word", F.col("w.n").alias("times")).join(words, "word", "left")
    c = F.coalesce("n", F.lit(0))
    rest = rare.groupBy("key").agg(F.sum(F.col("times") * F.log10(c + 0.1)).alias("rest"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("met"))
    out = done.drop("rare").join(rest, "key", "left")
    tokens = F.col("n_words") + 1
    base = F.col("base") + F.coalesce("rest", F.lit(0.0)) + float(np.log10(ends + 0.1)) - tokens * float(np.log10(n + 0.1 * (v + 1)))
    known = F.col("known") + F.coalesce("met", F.lit(0)) + (1 if ends else 0)
    return out.select(F.col("id").alias(id_col), "held_out", tokens.alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
