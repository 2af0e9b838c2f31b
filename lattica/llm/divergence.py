"""Source divergence audit: how far apart the sources of a language are in their terms, by tiles of groups and terms.

Terms are counted once per document and summed up by (language, source, term). A language's kept terms are dealt over blocks; a tile is the dense
matrix of up to GROUPS sources by one block of terms. All pairs of a tile's rows are compared at once, the partial pair matrices are
summed, and each tile's heads of the per-source ranking are merged.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import stage

#: Rows and, about, columns of a tile.
GROUPS, TERMS = 256, 1024
#: Terms that a task sums up before it hands them on.
HELD = 400_000
#: Heads that a task merges before it hands them on.
HEADS = 4_096
SCALE_STEPS = 3  # 1000 ** 3 is the scale of the shares

#: Letters to lower case, bytes above ASCII as they are, everything else apart.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held_terms: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term by group; each group has a row with the empty term and zeros.

    Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII. Null text, lang and source count as ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in n.items():
                d, size = docs[lang, source], len(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array([source] * size), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64()), pa.array([d[t] for t in c], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            n.clear()
            docs.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                group = lang.as_py(), source.as_py()
                if group not in n:
                    n[group], docs[group] = Counter({b"": 0}), Counter()
                c, d = n[group], docs[group]
                before = len(c)
                found = text.as_py().translate(_FOLD).split()
                c.update(found)
                d.update(set(found))
                held += len(c) - before
                if held > held_terms:
                    yield from hand_on()
                    held = 0
        yield from hand_on()

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    counted = docs.select(blank[0].alias("lang"), blank[1].alias("source"), blank[2].cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / of) for 0 <= count <= of < 2**53, by long division, so that nothing overflows."""
    out, rest = np.zeros(np.broadcast(count, of).shape, np.int64), count
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def _tiles(top: int, high: int, held_heads: int):
    """Tiles from rows sorted by (lang, gi, gj, block): markers (no term) hold a group's denominator, others a count; g -1 is the language."""

    def compare(lang: str, gi: int, gj: int, g: np.ndarray, term: np.ndarray, n: np.ndarray, pairs: dict, heads: dict) -> None:
        mark = np.equal(term, None)
        groups, at = np.unique(g[mark], return_index=True)  # the first row is the language
        of = n[mark][at]
        terms = sorted({t for t in term if t is not None})
        column = {t: k for k, t in enumerate(terms)}
        counts = np.zeros((len(groups), len(terms)), np.int64)
        rows = np.searchsorted(groups, g[~mark])
        counts[rows, [column[t] for t in term[~mark]]] = n[~mark]
        p = share(counts + 5, of[:, None])
        own = groups // high
        left, right = (np.flatnonzero((own == k) & (groups >= 0)) for k in (gi, gj))
        if (total := pairs.get((lang, gi, gj))) is None:
            pairs.clear()  # rows are sorted: the matrix before has been handed on
            total = pairs[lang, gi, gj] = (groups[left], groups[right], np.zeros((len(left), len(right)), np.int64))
        for k, row in enumerate(left):
            total[2][k] += np.abs(p[row] - p[right]).sum(axis=1)
        if gi == gj:
            for row in left:
                over = np.flatnonzero((counts[row] > 0) & (p[row] > p[0]))
                f = p[row, over] - p[0, over]
                best = np.lexsort((over, -f))[:top]
                some = [(-int(f[b]), terms[over[b]], int(p[0, over[b]])) for b in best]
                key = lang, int(groups[row])
                heads[key] = list(heapq.merge(heads.get(key, []), some))[:top]

    def out(kind: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*kind, strict=True))
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "a", "b", "item", "q", "value"])

    def given(pairs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, gi, gj), (a, b, total) in pairs.items():
            i, j = np.nonzero((a[:, None] < b[None]) if gi == gj else np.ones(total.shape, bool))
            if len(i):
                size = len(i)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(a[i]), pa.array(b[j]), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int64()), pa.array(total[i, j])], names=["lang", "a", "b", "item", "q", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict = {}
        heads: dict = {}
        now, held = None, []

        def whole() -> Iterator[pa.RecordBatch]:
            if now is not None:
                if pairs and now[:3] not in pairs:
                    yield from given(pairs)
                t = pa.concat_tables(held)
                compare(*now[:3], t.column(4).to_numpy(), np.array(t.column(5).to_pylist(), object), t.column(6).to_numpy(), pairs, heads)
                if len(heads) > held_heads:
                    yield from handed()

        def handed() -> Iterator[pa.RecordBatch]:
            some = [(lang, g, None, t, q, -f) for (lang, g), rows in heads.items() for f, t, q in rows]
            heads.clear()
            if some:
                yield out(some)

        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a] != now:
                    yield from whole()
                    now, held = keys[a], []
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        yield from whole()
        yield from given(pairs)
        yield from handed()

    return run


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", tile: tuple[int, int] = (GROUPS, TERMS), held_terms: int = HELD, held_heads: int = HEADS) -> DataFrame:
    """(lang, source, part, item, q, value, rank) for every (lang, source) that occurs.

    A language keeps its V terms in at least least_docs of its documents. A group, and a language, gives a kept term the share
    p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), N its occurrences of kept terms. Part `pair`: item is each other source of the language, value the sum of
    abs(p - its p) over the kept terms (0 without any). Part `term`: item is each kept term that occurs in the group with p > q, q the language's share, value p - q,
    the first `top` ranks. Ranks go by value descending, then item by UTF-8 bytes. q is null in part `pair`. Null text, lang and source are read as ''.
    A repeated row counts as a document of its own. An empty table gives no rows. Counts of a group are exact up to 2**53. tile: sources and, about, terms of a tile; held_terms and held_heads: what a task
    holds before it hands on.
    """
    counts = stage(term_counts(docs, lang_col, source_col, text_col, held_terms))
    kept = counts.where("docs > 0").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs)
    kept = stage(kept.select("lang", "term", "n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
    mine = stage(counts.where("docs > 0").select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"]))
    sums = mine.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = groups.select("lang", "source", number.alias("g"), (F.coalesce("n", F.lit(0)) + 5 * v).alias("of"), v.alias("v"), (F.coalesce("lang_n", F.lit(0)) + 5 * v).alias("lang_of"))
    groups = stage(groups.withColumn("of", F.greatest("of", F.lit(1))).withColumn("lang_of", F.greatest("lang_of", F.lit(1))))
    blocks = F.greatest(F.ceil(F.col("v") / tile[1]), F.lit(1)).cast("int")
    spans = stage(groups.groupBy("lang").agg(F.first("lang_of").alias("lang_of"), F.first("v").alias("v"), F.ceil((F.max("g") + 1) / tile[0]).cast("int").alias("bands")).withColumn("blocks", blocks))

    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    binary = F.col("term").cast("binary").alias("term")
    none = F.lit(None).cast("binary").alias("term")
    shape = ["lang", "bands", "block", "g", "term", "n"]
    rows = mine.join(groups.select("lang", "source", "g"), ["lang", "source"]).join(spans, "lang").select("lang", "bands", block.alias("block"), "g", binary, "n")
    whole = kept.join(spans, "lang").select("lang", "bands", block.alias("block"), F.lit(-1).cast("long").alias("g"), binary, "n")
    marks = groups.select("lang", "g", "of").join(spans, "lang").select("lang", "bands", every.alias("block"), "g", none, F.col("of").alias("n"))
    whole_marks = spans.select("lang", "bands", every.alias("block"), F.lit(-1).cast("long").alias("g"), none, F.col("lang_of").alias("n"))
    band = F.floor(F.col("g") / tile[0]).cast("int")
    last = F.col("bands") - 1
    # band b meets the tiles (i, b) for i <= b and (b, j) for j > b; the language's rows meet all, as they name all terms
    own = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.least(k, band).alias("i"), F.greatest(k, band).alias("j")))
    every_tile = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: F.transform(F.sequence(k, last), lambda j: F.struct(k.alias("i"), j.alias("j")))))
    dealt = rows.select(shape).union(marks.select(shape)).withColumn("tile", F.explode(own)).union(whole.select(shape).union(whole_marks.select(shape)).withColumn("tile", F.explode(every_tile)))
    key = ["lang", "gi", "gj", "block"]
    dealt = dealt.select("lang", F.col("tile.i").alias("gi"), F.col("tile.j").alias("gj"), "block", "g", "term", "n")
    found = stage(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_tiles(top, tile[0], held_heads), "lang string, a long, b long, item binary, q long, value long"))

    names = groups.select("lang", F.col("g").alias("a"), F.col("source"))
    pairs = found.where("b is not null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "value").select("lang", "p.a", "p.b", "value")
    both = both.join(names, ["lang", "a"]).join(names.withColumnsRenamed({"a": "b", "source": "item"}), ["lang", "b"])
    terms = found.where("b is null").select("lang", "a", F.col("item").cast("string").alias("item"), "q", "value").join(names, ["lang", "a"])

    def ranked(df: DataFrame, part: str, q: Column) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        return df.select("lang", "source", F.lit(part).alias("part"), "item", q.cast("long").alias("q"), "value", F.row_number().over(order).alias("rank"))

    return ranked(both, "pair", F.lit(None)).union(ranked(terms, "term", F.col("q")).where(F.col("rank") <= top))
