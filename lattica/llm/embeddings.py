"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stage
from lattica.llm.graph import connected_components

#: Chance that a pair exactly at the threshold meets in at least one table; closer pairs meet more often.
RECALL = 0.98
#: Rows of a block. A larger bucket is dealt over blocks, and pairs of blocks are compared one by one.
BLOCK = 512


def shape(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits and tables for n vectors: bits grow with log2(n), so that chance buckets stay at about a hundred; tables follow from the recall."""
    bits = max(8, math.ceil(math.log2(max(n, 2))) - 7)
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = RECALL, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row: id, n_links (other rows found with cosine >= `cosine`), component_id, kept.

    Vectors that are null, empty or zero, or hold nulls, NaN or infinities, link with nothing. Vectors only meet
    vectors of their own length. Rows with equal vectors are one class, compared once and counted with its size, so no
    pairs are made within a group of copies; one of a class's links to itself stands for all of them. A pair is counted in
    the first table in which it meets. Rows with a repeated id are rows like any other and each come back. Rows with a null id link with
    nothing and are returned with null component and kept. Other columns are left out. Classes are known by 64-bit hashes.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.size("v") > 0
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    # scaled by the largest component first, so squares neither overflow nor vanish
    usable = F.col("v").isNotNull() & finite & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (top > 0)
    rows = stage(raw.withColumn("ok", F.coalesce(usable, F.lit(False)) & F.col("id").isNotNull()).withColumn("key", F.when(F.col("ok"), F.sha2(F.to_binary(F.array_join(F.transform("v", lambda x: F.hex(x.cast("string"))), "2C"), F.lit("hex")), 256))))
    classes = rows.where("ok").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = stage(classes.withColumns({"rep": F.xxhash64("key"), "v": F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y))))}))
    bits, tables = shape(classes.count(), cosine, recall)
    counted, edges = _links(classes.select("rep", "copies", "v"), cosine, bits, tables, seed)
    components = connected_components(edges).withColumnRenamed("id", "rep")
    known = classes.select("key", "rep", "copies", "least").join(counted, "rep", "left").join(components, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = stage(known.select("key", "component", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    least = stage(known.groupBy("component").agg(F.min("least").alias("component_id")))
    per_class = stage(known.join(least, "component").select("key", "n_links", "component_id"))  # written, so that many copies are a side that Spark splits
    out = rows.select("id", "key").join(per_class, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def _links(classes: DataFrame, cosine: float, bits: int, tables: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Per class, the rows of linked classes (rep, n); and edges that connect what a bucket links (a, b).

    Buckets of one are dropped before vectors are attached. The others are sorted streams: a task holds two blocks at a time.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch.column(2)
            dims = v.value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == dim))
                x = v.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
                codes = (((x @ planes[dim]) > 0).reshape(len(x), tables, bits) << np.arange(bits)).sum(axis=2).astype(np.int64)
                n = len(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * tables, pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([dim] * n, pa.int32()), lists, pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["rep", "copies", "dim", "codes", "signs", "v"],
                )

    signed = stage(classes.select("rep", "copies", "v").mapInArrow(sign, "rep long, copies long, dim int, codes array<long>, signs binary, v binary"))
    buckets = signed.select("rep", "dim", F.posexplode("codes").alias("tab", "code"))
    sizes = stage(buckets.groupBy("dim", "tab", "code").count().where("count > 1").select("dim", "tab", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    placed = buckets.join(sizes, ["dim", "tab", "code"]).withColumn("block", F.pmod(F.xxhash64("rep", "tab"), F.col("blocks")).cast("int"))
    # block i meets blocks i, i + 1, ...: a row of block b goes to the pairs (i, b) for i <= b and (b, j) for j > b
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    placed = placed.select("rep", "dim", "tab", "code", "block", F.explode(pairs).alias("p")).select("rep", "dim", "tab", "code", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block")
    members = placed.join(signed.select("rep", "copies", "signs", "v"), "rep")
    key = ["dim", "tab", "code", "i", "j"]

    def compare(x: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A bucket's blocks: of rows with links, the row, the rows of linked classes, and the smallest row reached inside this bucket."""
        dim, tab, i, j = (x.column(k)[0].as_py() for k in (0, 1, 3, 4))
        block, reps, copies = (x.column(k).to_numpy() for k in (5, 6, 7))
        codes, v = (np.frombuffer(b"".join(x.column(k).to_pylist()), t).reshape(len(x), -1) for k, t in ((8, np.int64), (9, np.float64)))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.nonzero(v[left] @ v[right].T >= cosine - 1e-9)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        exact = (v[a] * v[b]).sum(axis=1) >= cosine
        a, b = a[exact], b[exact]
        label = np.arange(len(x))
        while len(a):
            old = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = label[label]
            if (old == label).all():
                break
        fresh = ~(codes[a, :tab] == codes[b, :tab]).any(axis=1)
        n = np.bincount(a[fresh], copies[b[fresh]], len(x)) + np.bincount(b[fresh], copies[a[fresh]], len(x))
        hit = (n > 0) | (label != np.arange(len(x)))
        return reps[hit], n[hit].astype(np.int64), reps[label[hit]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(t: pa.Table, opens: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.append(np.flatnonzero(opens), len(t)).tolist()
            whole = t.combine_chunks().to_batches()
            found = [compare(whole[0].slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1] if whole else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["rep", "n", "to"])

        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            opens = np.ones(len(t), bool)
            opens[1:] = np.any([c[1:] != c[:-1] for c in (t.column(k).to_numpy() for k in range(len(key)))], axis=0)
            tail = int(np.flatnonzero(opens)[-1])  # the last bucket may go on
            yield from groups(t.slice(0, tail), opens[:tail])
            rest = t.slice(tail)
        if rest is not None:
            yield from groups(rest, np.arange(len(rest)) == 0)

    sorted_ = members.select(*key, "block", "rep", "copies", "signs", "v").repartition(*key).sortWithinPartitions(*key)
    found = stage(sorted_.mapInArrow(run, "rep long, n long, to long"))
    return found.groupBy("rep").agg(F.sum("n").alias("n")), found.select(F.col("rep").alias("a"), F.col("to").alias("b"))
