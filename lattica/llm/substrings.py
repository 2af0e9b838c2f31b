"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts anywhere else.

Every such string holds an anchor, a place chosen by content alone (the least hash of GRAM-byte strings in a window), so
equal strings hold it at the same offset. Anchors with equal GRAM bytes are a group; what follows them and, reversed, what
precedes them is suffix-sorted, and the longest common prefixes of neighbours bound which strings around an anchor can
occur again. Where one neighbour reaches both bounds the whole stretch repeats; elsewhere the candidate strings are compared
themselves. Groups too large for one task are settled by hashing their strings across the cluster. Texts equal as a
whole are one text to all of this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from lattica.llm.common import drop_staged, release, stage
from lattica.llm.shingles import mix, utf8
from lattica.llm.suffixes import common, deep_shallow_sort

#: Bytes that members of a group share at least. Longer grams meet less often by chance, shorter ones make fewer anchors.
GRAM = 100
#: Members of a group that one task sorts; larger groups are dealt over the cluster by their strings' hashes.
GROUP = 3_000
#: Bytes hashed at once; a power of two of 22 bits at most, as a place is kept in the low bits of a hash.
PIECE = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(99))
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of `width` bytes, by where they start. At most PIECE bytes."""
    if len(raw) < width:
        return np.zeros(0, np.uint64)
    if PIECE not in _TABLES:
        _TABLES[PIECE] = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 1 << 64), PIECE)
    up, down = _TABLES[PIECE]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: len(raw) - width + 1])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, hash of the gram there): the leftmost least gram of every string of `length` bytes within a row."""
    rows, places, keys = [], [], []
    a, n_rows = 0, len(offsets) - 1
    while a < n_rows:
        b = a + 1
        while b < n_rows and offsets[b + 1] - offsets[a] <= PIECE:
            b += 1
        # a row longer than a piece is cut into pieces that overlap by length - 1
        start, end = int(offsets[a]), int(offsets[b])
        while True:
            stop = min(end, start + PIECE)
            at, key = _anchors(raw[start:stop], np.clip(offsets[a : b + 1] - start, 0, stop - start), length)
            row = np.searchsorted(offsets[a : b + 1], at + start, "right") - 1 + a
            rows.append(row)
            places.append(at + start - offsets[row])
            keys.append(key)
            if stop == end:
                break
            start = stop - length + 1
        a = b
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    row, place, key = (np.concatenate(x) for x in (rows, places, keys))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    return row[new], place[new], key[new]


def _anchors(raw: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    h, w = gram_hashes(raw, GRAM), length - GRAM + 1
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << 22) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    # least of each window of w: the end of one block of w and the beginning of the next
    pad = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(v)] = v
    blocks = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - w + 1
    least = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)
    # strings that do not cross an edge between rows
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(edges[1:-1] - length + 1, 0, n), 1)
    np.add.at(step, np.clip(edges[1:-1], 0, n), -1)
    inside = np.cumsum(step[:-1]) == 0
    least = least[inside]
    at = least[np.concatenate([[True], least[1:] != least[:-1]])] if len(least) else least
    return at, h[at].view(np.int64)


def repeats(contexts: list[tuple[bytes, bytes]], counts: list[int], length: int) -> list[tuple[int, int]]:
    """For each member, given what precedes it (reversed), what follows and at how many places, how far (bytes before, bytes after)
    the strings around the anchor that are found at another place reach; (0, 0) if there are none. All of them hold the anchor, so
    together they are one stretch. Members are distinct."""
    m = len(contexts)
    out = [(len(a), len(b)) if n > 1 and len(a) + len(b) >= length else (0, 0) for (a, b), n in zip(contexts, counts, strict=True)]

    def reach(i: int, left: int, right: int) -> None:
        out[i] = (max(out[i][0], left), max(out[i][1], right))

    if m <= 3:
        for i in range(m):
            for j in range(i):
                left, right = common(contexts[i][0], contexts[j][0]), common(contexts[i][1], contexts[j][1])
                if left + right >= length:
                    reach(i, left, right)
                    reach(j, left, right)
        return out
    most = []
    near: list[set[int]] = [set() for _ in range(m)]
    for side in (0, 1):
        strings = [c[side] for c in contexts]
        order = deep_shallow_sort(strings)
        lcp = [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
        best = [0] * m
        for k, n in enumerate(lcp):
            a, b = order[k], order[k + 1]
            best[a], best[b] = max(best[a], n), max(best[b], n)
            near[a].add(b)
            near[b].add(a)
        most.append(best)
    open_ = []
    for i in range(m):
        left, right = most[0][i], most[1][i]
        if left + right < length or out[i][1]:
            continue
        done = any(common(contexts[i][0], contexts[j][0]) == left and common(contexts[i][1], contexts[j][1]) == right for j in near[i])
        if done:
            reach(i, left, right)
        else:
            open_.append(i)
    if not open_:
        return out
    # strings with `o` bytes before the anchor, for every o that both bounds allow
    wanted = set(open_)
    whole = [a[::-1] + b for a, b in contexts]
    for o in sorted({o for i in open_ for o in range(length - most[1][i], most[0][i] + 1)}):
        found: dict[bytes, list[int]] = {}
        for i in range(m):
            if length - most[1][i] <= o <= most[0][i]:
                at = len(contexts[i][0]) - o
                found.setdefault(whole[i][at : at + length], []).append(i)
        for members in found.values():
            if len(members) > 1:
                for i in members:
                    if i in wanted:
                        reach(i, o, length - o)
    return out


def spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class, n_bytes, spans): for rows that lose bytes, the ascending, disjoint stretches [start, end) of their UTF-8 bytes.

    class is a hash of the text; rows with equal doc_id and text have one entry here.
    """
    back = length - GRAM
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("class", F.xxhash64("text"))
    slim = stage(texts.select("doc_id", "class", F.octet_length("text").cast("long").alias("n_bytes")).where(F.col("n_bytes") >= length))
    classes = slim.groupBy("class", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, key = anchors(*utf8(batch.column(1)), length)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(key)], names=["class", "place", "key"])

    long = texts.where(F.octet_length("text") >= length)
    found = stage(long.select("class", "text").mapInArrow(find, "class long, place int, key long").dropDuplicates())
    # keys are written before they are joined with, so that a passage that many texts share is a skewed side, which Spark splits
    again = stage(found.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"))
    shared = stage(found.join(again, "key", "left_semi"))
    drop_staged(found)
    release(docs.sparkSession)

    # the bytes around shared anchors, once a text: by class alone, as a row's id may be null
    places = shared.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for cls, text, marks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw, seen = text.encode(), set()
                    for p in marks:
                        place = p["place"]
                        before, after = raw[max(0, place - back) : place][::-1], raw[place : place + length]
                        digest = hashlib.blake2b(len(before).to_bytes(4, "little") + before + after, digest_size=16).digest()
                        new = (p["key"], digest) not in seen  # the bytes once a text
                        seen.add((p["key"], digest))
                        for col, x in zip(out, (p["key"], digest, cls, place, before if new else None, after if new else None), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["key", "digest", "class", "place", "before", "after"])

    around = long.select("class", "text").dropDuplicates(["class"]).join(places, "class").select("class", "text", "places")
    around = stage(around.mapInArrow(cut, "key long, digest binary, class long, place int, before binary, after binary"))
    drop_staged(shared)
    release(docs.sparkSession)
    marks = around.select("key", "digest", "class", "place")
    counts = stage(marks.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("count")))
    sizes = stage(counts.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("count").alias("places")).where("places > 1").drop("places"))
    members = around.where("before is not null").select("key", "digest", "before", "after").dropDuplicates(["key", "digest"])
    members = stage(members.join(counts.join(sizes, "key"), ["key", "digest"]).select("key", "size", "digest", "count", "before", "after"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for x in t.combine_chunks().to_batches():
                key = x.column(0).to_numpy()
                count, before, after = (x.column(k).to_pylist() for k in (2, 3, 4))
                cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])).tolist()
                hits = [(a + i, got) for a, b in zip(cuts, cuts[1:], strict=False) for i, got in enumerate(repeats(list(zip(before[a:b], after[a:b], strict=True)), count[a:b], length)) if got[1]]
                who = pa.array([i for i, _ in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([x.column(0).take(who), x.column(1).take(who), *(pa.array([got[side] for _, got in hits], pa.int64()) for side in (0, 1))], names=["key", "digest", "left", "right"])

        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            key = t.column(0).to_numpy()
            tail = int(np.searchsorted(key, key[-1]))  # the last group may go on
            yield from groups(t.slice(0, tail))
            rest = t.slice(tail)
        if rest is not None:
            yield from groups(rest)

    small = members.where(F.col("size") <= GROUP).select("key", "digest", "count", "before", "after")
    pieces = small.repartition("key").sortWithinPartitions("key").mapInArrow(settle, "key long, digest binary, left long, right long")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                key, digest, count, before, after = (batch.column(k)[i].as_py() for k in range(5))
                h = gram_hashes(np.frombuffer(before[::-1] + after, np.uint8), length).view(np.int64)
                o = len(before) - np.arange(len(h))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.int64()), pa.array([digest] * len(h), pa.binary()), pa.array([count] * len(h), pa.int64()), pa.array(o.astype(np.int64)), pa.array(h)], names=["key", "digest", "count", "o", "h"])

    # o: the anchor's place in the string; a string that holds two anchors of one key is met twice, but not at one o
    big = members.where(F.col("size") > GROUP).select("key", "digest", "count", "before", "after").mapInArrow(strings, "key long, digest binary, count long, o long, h long")
    twice = stage(big.groupBy("key", "o", "h").agg(F.sum("count").alias("n")).where("n > 1").select("key", "o", "h"))
    runs = big.join(twice, ["key", "o", "h"], "left_semi").groupBy("key", "digest").agg(F.max("o").alias("left"), F.max(length - F.col("o")).alias("right"))

    found = marks.join(pieces.union(runs), ["key", "digest"]).select("class", (F.col("place") - F.col("left")).alias("lo"), (F.col("place") + F.col("right")).alias("hi"))
    covered = found.groupBy("class").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("s"))
    covered = stage(covered.select("class", _merged("s").alias("spans")))
    drop_staged(around)
    drop_staged(members)
    release(docs.sparkSession)
    per_class = classes.join(covered, "class", "left").select("class", "n_bytes", F.when(F.col("copies") > 1, F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))).otherwise(F.col("spans")).alias("spans"))
    return slim.distinct().join(per_class.where("spans is not null"), ["class", "n_bytes"])


@F.pandas_udf(ArrayType(StructType([StructField("lo", LongType()), StructField("hi", LongType())])))
def _merged(stretches: pd.Series) -> pd.Series:
    """Ascending stretches, with those that touch or overlap as one."""

    def merge(found) -> list[dict]:
        lo, hi = (np.array([x[k] for x in found], np.int64) for k in ("lo", "hi"))
        most = np.maximum.accumulate(hi)
        opens = np.concatenate([[True], lo[1:] > most[:-1]])
        ends = np.append(most[:-1][opens[1:]], most[-1])
        return [{"lo": a, "hi": b} for a, b in zip(lo[opens].tolist(), ends.tolist(), strict=True)]

    return pd.Series([merge(x) for x in stretches], dtype=object)


@F.pandas_udf(BinaryType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """What is left of a text's UTF-8 bytes."""

    def cut(t: str | None, s) -> bytes:
        raw, out, at = (t or "").encode(), [], 0
        for x in s if s is not None else ():
            out.append(raw[at : x["lo"]])
            at = x["hi"]
        return b"".join(out) + raw[at:]

    return pd.Series([cut(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def readable(kept: pd.Series) -> pd.Series:
    """Bytes as text, without what is left of characters that were cut in two; null stays null."""
    return kept.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept (binary: the remaining bytes in order), n_bytes, n_removed, n_spans (long).

    A byte is removed if a string of `length` bytes covers it that starts at another place too, in this or any other row; strings are
    judged on the input. Strings never cross rows. Null texts count as empty; texts shorter than `length` stay whole.
    Equal texts of `length` bytes or more all go. A row with a null id is a row like any other. Every row comes back; input columns called like an output column are replaced.
    """
    gone = spans(docs, length, id_col, text_col).select(F.col("doc_id").alias("_x_id"), F.col("class").alias("_x_class"), F.col("spans").alias("_x_spans"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("_x_hash", F.xxhash64(text)).join(gone, F.col(id_col).eqNullSafe(F.col("_x_id")) & (F.col("_x_hash") == F.col("_x_class")), "left")
    cut = F.col("_x_spans").isNotNull()
    new = {
        # only texts that lose bytes go through Python
        "kept": F.when(cut, _without(F.when(cut, text), F.col("_x_spans"))).otherwise(F.encode(text, "UTF-8")),
        "n_bytes": F.octet_length(text).cast("long"),
        "n_removed": F.coalesce(F.aggregate("_x_spans", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"]), F.lit(0)),
        "n_spans": F.coalesce(F.size("_x_spans"), F.lit(0)).cast("long"),
    }
    kept = [c for c in docs.columns if c.lower() not in new]
    return out.select(*[docs[c] for c in kept], *[c.alias(k) for k, c in new.items()])
