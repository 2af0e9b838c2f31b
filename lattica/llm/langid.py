"""Language identification by multilingual mixture inference.

Each word of a document comes from one of the document's languages, with the likelihood of its letter n-grams in that
language. Expectation-maximisation estimates the proportions; the set of languages is the one with the best penalised
likelihood among nested sets of the likeliest languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stage, unit_hash

#: Labelled documents to learn from, per language, about (the draw is by hash): the one bound on a sample here.
LEARN_PER_LANGUAGE = 3_000
#: Bins of hashed n-grams. With L languages, L * BINS counts reach the driver and as many numbers the tasks.
BINS = 1 << 16
#: Letters of an n-gram; words are padded with a space on either side.
ORDERS = (2, 3, 4)
ROUNDS = 8
UNKNOWN = "und"


@lru_cache(1)
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case with 0 for what is no letter, and where each text begins in them."""
    each = [f"\n\n\n\n{t.lower()}\n" for t in texts]  # no n-gram reaches into another text
    codes = np.frombuffer("".join(each).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letter_table()[codes], codes, 0), np.cumsum([0, *map(len, each)])


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """At each place, the bin of the n-gram that ends there."""
    h = np.full(len(codes), order * 0x9E3779B1, np.uint64)
    for k in range(order):
        h[order:] = h[order:] * np.uint64(0x100000001B3) + codes[order - k : len(codes) - k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 16)).astype(np.int64) & (BINS - 1)


def _places(codes: np.ndarray) -> np.ndarray:
    """Where an n-gram may end: at letters, and just after a word."""
    letter = codes != 0
    at = letter.copy()
    at[1:] |= letter[:-1]
    at[: max(ORDERS)] = False
    return np.flatnonzero(at)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = LEARN_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order, and log-likelihoods (len(ORDERS) * BINS, languages). Rows without text or language are left out."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), unit_hash(F.col(id_col), seed=7).alias("draw"))
    sizes = stage(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), files=1)  # a row per language
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not langs:
        return [], np.zeros((len(ORDERS) * BINS, 0), np.float32)
    drawn = labelled.join(sizes, "lang").where(F.col("draw") < per_language / F.col("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in set(langs):
                codes, _ = _letters([t for t, x in zip(texts, langs, strict=True) if x == lang])
                at = _places(codes)
                n = total.setdefault(lang, np.zeros(len(ORDERS) * BINS, np.int64))
                for k, order in enumerate(ORDERS):
                    n[k * BINS : (k + 1) * BINS] += np.bincount(_grams(codes, order)[at], minlength=BINS)
        for lang, n in total.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit), pa.array(n[hit])], names=["lang", "bin", "n"])

    counted = drawn.select("lang", "text").mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    counts = np.zeros((len(ORDERS) * BINS, len(langs)))
    counts[table["bin"].to_numpy(), np.searchsorted(langs, table["lang"].to_pylist())] = table["n"].to_numpy()
    by_order = counts.reshape(len(ORDERS), BINS, len(langs)) + 0.5
    return langs, np.log(by_order / by_order.sum(axis=1, keepdims=True)).reshape(counts.shape).astype(np.float32)


#: Code points scored at once: bounds what a task holds beside texts and words.
CHUNK = 1 << 20


def _word_scores(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (words, languages) and where each word begins; in chunks that end between words."""
    scores, places, at = [np.zeros((0, table.shape[1]))], [np.zeros(0, np.int64)], 0
    while at < len(codes):
        end = min(at + CHUNK, len(codes))
        while end < len(codes) and not (gaps := np.flatnonzero(codes[end : end + CHUNK] == 0)).size:
            end = min(end + CHUNK, len(codes))
        end = end + int(gaps[0]) + 1 if end < len(codes) else end
        start = max(0, at - max(ORDERS))
        part = codes[start:end]
        found = _places(part)
        found = found[found >= at - start]
        if len(found):
            # a place that follows a non-place or a word's end opens a word
            first = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1] + 1) | (part[found[:-1]] == 0)]))
            score = sum(table[k * BINS + _grams(part, order)[found]] for k, order in enumerate(ORDERS))
            scores.append(np.add.reduceat(score, first, axis=0).astype(np.float64) / len(ORDERS))  # the orders overlap, so their mean
            places.append(found[first] + start)
        at = end
    return np.concatenate(scores), np.concatenate(places)


def mixtures(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts, languages), 0 outside the chosen set, and the number of words; without words, proportions are 0."""
    n_langs = table.shape[1]
    codes, begins = _letters(texts)
    out, n_words = np.zeros((len(texts), n_langs)), np.zeros(len(texts), np.int64)
    ll, place = _word_scores(codes, table)
    if not len(place):
        return out, n_words
    doc = np.searchsorted(begins, place, "right") - 1
    docs, starts, n = np.unique(doc, return_index=True, return_counts=True)
    local = np.repeat(np.arange(len(docs)), n)
    n_words[docs] = n
    top = ll.max(axis=1, keepdims=True)
    p = np.exp(ll - top)

    def em(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(ROUNDS):
            r = theta[local] * p
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            theta = np.add.reduceat(r, starts, axis=0) / n[:, None]
        fit = np.log(np.maximum((theta[local] * p).sum(axis=1), 1e-300))
        return theta, np.add.reduceat(fit, starts)

    single = np.add.reduceat(ll - top, starts, axis=0)
    best_one = single.argmax(axis=1)
    theta = np.eye(n_langs)[best_one]
    value = single.max(axis=1)
    if n_langs > 1:
        full, _ = em(np.full((len(docs), n_langs), 1 / n_langs))
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        going = np.ones(len(docs), bool)  # a text stops at the first language that doesn't pay, whatever other texts do
        for k in range(2, n_langs + 1):
            tried, fit = em(np.where(rank < k, np.maximum(full, 1e-6), 0) / np.where(rank < k, np.maximum(full, 1e-6), 0).sum(axis=1, keepdims=True))
            fit -= (k - 1) * (2 + np.log(n))  # a further language has to pay for its proportion
            going = better = going & (fit > value)
            if not better.any():
                break
            theta, value = np.where(better[:, None], tried, theta), np.where(better, fit, value)
    out[docs] = theta
    return out, n_words


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (its proportion), languages (map of the chosen set to proportions).

    Null texts, texts without a letter, and all texts if nothing was learned are `und` with score 0 and an empty map. Ties go to the
    language first in code-point order. Whole texts are used; batches are cut by characters, so long texts go alone.
    """
    model = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cuts, size = [0], 0
            for i, t in enumerate(texts):
                if size > 1_000_000:
                    cuts.append(i)
                    size = 0
                size += len(t or "")
            for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                theta, words = mixtures([t or "" for t in texts[a:b]], model.value) if langs else (np.zeros((b - a, 1)), np.zeros(b - a))
                best = theta.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([langs[k] if n else UNKNOWN for k, n in zip(best, words, strict=True)], pa.string()),
                        pa.array(np.clip(theta.max(axis=1), 0, 1)),
                        pa.array([[(langs[k], float(x[k])) for k in np.flatnonzero(x)] for x in theta], pa.map_(pa.string(), pa.float64())),
                    ],
                    names=[id_col, "lang_pred", "score", "languages"],
                )

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, languages map<string,double>")
