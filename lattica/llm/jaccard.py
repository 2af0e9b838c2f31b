"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

Two sets of Jaccard similarity t or more share a member among the first n - ceil(t n) + 1 of each in any fixed order
of all members. The rows that hold the same such member are a tile, and its first row by size leads it. The order puts
members that many rows hold last, so passages that many texts share make no large tiles. A pair's bitmaps bound its overlap from
above: each bit that only one side has set is a member that the other side lacks. First each row meets the leaders of its
tiles: by sizes, bitmaps and, where these leave the threshold within reach, exactly. What that links is one component, so a group of near
copies is settled in time linear in its size. Then rows that their leader does not link are compared with the leader's other rows, in blocks
and again by sizes, bitmaps and exact intersection, where they are in different components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import drop_staged, release, stage
from lattica.llm.graph import connected_components
from lattica.llm.shingles import Bloom, mix, shingle_sets

#: Rows that hold a member among their first before it goes last in the order; and members that go last, at most:
#: beyond that the count rises. They are sent to the tasks as a Bloom filter of at most 4 MB, on which all rows agree.
COMMON_ROWS = 48
COMMON_MEMBERS = 1_000_000
#: Bits of a signature: a power of two, about twice the members, within these.
SIGNATURE = (1024, 1 << 17)
#: Rows of a block when the rows of a leader are compared pair by pair.
BLOCK = 256


def _first(n: np.ndarray | int, per_cent: int):
    return n - -(-per_cent * n // 100) + 1


def _bitmap(members: np.ndarray) -> bytes:
    size = min(max(SIGNATURE[0], 1 << math.ceil(math.log2(2 * len(members)))), SIGNATURE[1])
    bits = np.zeros(size, bool)
    bits[mix(members ^ np.uint64(0x5DEECE66D)) & np.uint64(size - 1)] = True
    return np.packbits(bits).tobytes()


def _class(members: np.ndarray) -> int:
    return int(mix(mix(members + np.uint64(0x632BE59BD9B4E019)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(members))).view(np.int64)[0])


def _sets(docs: DataFrame, width: int, per_cent: int, id_col: str, text_col: str, common: Bloom | None) -> DataFrame:
    """(doc_id, key, class, n, first, signature): equal sets have equal classes (null if empty); first: the members that place a row in tiles.

    A task gives first and signature once for each class that it meets, so copies are few in what is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = shared.value, set()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(1), width)
                n = np.array([len(s) for s in sets], np.int64)
                if last is not None:
                    flags = np.split(last.has(np.concatenate(sets)), np.cumsum(n)[:-1])
                    sets = [np.concatenate([s[~f], s[f]]) if f.any() else s for s, f in zip(sets, flags, strict=True)]
                classes = [_class(s) if len(s) else None for s in sets]
                new = [c is not None and c not in met and not met.add(c) for c in classes]
                heads = [s[: _first(len(s), per_cent)] if ok else s[:0] for s, ok in zip(sets, new, strict=True)]
                where = pa.array(np.cumsum([0, *map(len, heads)]), pa.int32())
                first = pa.ListArray.from_arrays(where, pa.array(np.concatenate(heads).view(np.int64)))
                signatures = pa.array([_bitmap(s) if ok else None for s, ok in zip(sets, new, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(classes, pa.int64()), pa.array(n), first, signatures], names=["doc_id", "key", "class", "n", "first", "signature"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, key long, class long, n long, first array<long>, signature binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key): the key is never null, and rows have one key if id (null or not) and text are equal."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("key"))


def _common(rows: DataFrame) -> Bloom | None:
    counts = stage(rows.select(F.explode("first").alias("m")).groupBy("m").count().where(F.col("count") > COMMON_ROWS).withColumn("level", F.floor(F.log2("count") * 4)))
    level, total = None, 0
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # a row for each quarter of a power of two
        if (total := total + row["count"]) > COMMON_MEMBERS:
            break
        level = row["level"]
    if level is None:
        return None
    members = counts.where(F.col("level") >= level).select("m").toArrow()["m"].to_numpy()
    return Bloom(members, 1 << min(25, max(10, math.ceil(math.log2(24 * len(members))))))


def _stars(rows: DataFrame) -> DataFrame:
    """(leader, class, n), distinct: for each row the leaders of its tiles, itself excepted.

    A tile's leader is its row of least size, then of least class (by its first 40 bits). Tiles are summed up before they are dealt
    out, and leaders written before rows are joined with them, so a member that many rows hold is a skewed side, which Spark splits.
    """
    entries = rows.select(F.explode("first").alias("m"), "class", "n")
    order = F.shiftleft(F.least(F.col("n"), F.lit((1 << 23) - 1)), 40).bitwiseOR(F.shiftrightunsigned("class", 24))
    leaders = entries.groupBy("m").agg(F.min_by("class", order).alias("leader"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("m", "leader")
    return entries.join(stage(leaders), "m").where("leader <> class").select("leader", "class", "n").distinct()


def _compatible(na: np.ndarray, nb: np.ndarray, per_cent: int) -> np.ndarray:
    return (100 * na >= per_cent * nb) & (100 * nb >= per_cent * na)


def _may_link(a: list[np.ndarray], b: list[np.ndarray], na: np.ndarray, nb: np.ndarray, per_cent: int) -> np.ndarray:
    """a, b: signatures as words, the longer of a pair folded to the shorter. Whether the bound on the overlap leaves the threshold within reach."""
    out = np.zeros(len(na), bool)
    width = np.minimum([len(x) for x in a], [len(x) for x in b]) if len(na) else np.zeros(0, int)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for part in np.array_split(at, -(-len(at) * int(w) // 4_000_000)):
            x, y = np.stack([_fold(a[k], w) for k in part]), np.stack([_fold(b[k], w) for k in part])
            only_a = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
            only_b = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
            most = np.minimum(na[part] - only_a, nb[part] - only_b)
            out[part] = (100 + per_cent) * most >= per_cent * (na[part] + nb[part])
    return out


def _fold(signature: np.ndarray, words: int) -> np.ndarray:
    while len(signature) > words:
        half = len(signature) // 2
        signature = signature[:half] | signature[half:]
    return signature


def _words(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _links(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    """Exact, on sorted distinct members."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges two sorted runs
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= per_cent * (len(a) + len(b) - shared)


def _near_leader(stars: DataFrame, signed: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): rows and leaders of theirs that sizes and signatures let link."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            na, nb = (x.column(k).to_numpy() for k in (2, 3))
            yield x.select([0, 1]).filter(pa.array(_may_link(_words(x.column(4)), _words(x.column(5)), na, nb, per_cent)))

    leads = signed.select(F.col("class").alias("leader"), F.col("n").alias("leader_n"), F.col("signature").alias("leader_signature"))
    sizes = stars.join(leads.select("leader", "leader_n"), "leader").where((100 * F.col("n") >= per_cent * F.col("leader_n")) & (100 * F.col("leader_n") >= per_cent * F.col("n")))
    both = sizes.join(signed.select("class", "signature"), "class").join(leads.select("leader", "leader_signature"), "leader")
    return both.select("class", "leader", "n", "leader_n", "signature", "leader_signature").mapInArrow(bound, "a long, b long")


def _verify(pairs: DataFrame, members: DataFrame, per_cent: int) -> DataFrame:
    """Of the pairs (a, b), those that link."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [_links(s, t, per_cent) for s, t in zip(_words(x.column(2)), _words(x.column(3)), strict=True)]
            yield x.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left, right = (members.select(F.col("class").alias(c), F.col("members").alias(f"m{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ma", "mb").mapInArrow(exact, "a long, b long")


def _grouped(stars: DataFrame, per_cent: int) -> DataFrame:
    """stars: (leader, class, n, comp, linked). (leader, class, n, comp), dealt over pairs of blocks: with i, j and the row's own block.

    Rows whose sizes may fit are in one band of sizes or in neighbouring ones, so a leader's rows meet within a band, and with the
    next. Rows that their leader links need not meet one another: of a pair of blocks, one has rows of the others. Blocks are
    numbered through the four kinds of a band's rows: its own others and linked ones, and those of the next band.
    """
    width = math.log(100 / per_cent) * (1 + 1e-9)  # a trifle wide, so that rounding leaves no fitting pair two bands apart
    band = F.floor(F.log("n") / width).cast("bigint")
    roles = F.explode(F.array(F.struct(band.alias("g"), F.lit(0).alias("up")), F.struct((band - 1).alias("g"), F.lit(1).alias("up"))))
    rows = stars.select("leader", "class", "n", "comp", "linked", roles.alias("r")).select("leader", "class", "n", "comp", "r.g", (2 * F.col("r.up") + F.col("linked").cast("int")).alias("kind"))
    counts = [F.ceil(F.count(F.when(F.col("kind") == k, 1)) / BLOCK).cast("int").alias(f"c{k}") for k in range(4)]
    sizes = rows.groupBy("leader", "g").agg(*counts, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi and (c0 > 0 or (c1 > 0 and c2 > 0))")
    placed = rows.join(stage(sizes.drop("lo", "hi")), ["leader", "g"])
    own = [F.col(f"c{k}") for k in range(4)]
    start = [F.lit(0), own[0], own[0] + own[1], own[0] + own[1] + own[2]]

    def pick(values: list[Column]) -> Column:
        return F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in enumerate(values)])

    def blocks(*kinds: int) -> Column:
        return F.flatten(F.array(*[F.when(own[k] > 0, F.sequence(start[k], start[k] + own[k] - 1)).otherwise(F.array().cast("array<int>")) for k in kinds]))

    placed = placed.withColumn("block", pick(start) + F.pmod(F.xxhash64("class", "leader"), pick(own)).cast("int"))
    # own others meet all, own linked ones others, the next band's others all of this band, its linked ones this band's others
    meets = pick([blocks(0, 1, 2, 3), blocks(0, 2), blocks(0, 1), blocks(0)])
    base = F.col("g") * 65_536  # a band's numbers apart from those of other bands
    pair = F.transform(meets, lambda k: F.struct((base + F.least(k, F.col("block"))).alias("i"), (base + F.greatest(k, F.col("block"))).alias("j")))
    dealt = placed.select("leader", (base + F.col("block")).alias("own"), "class", "n", "comp", F.explode(pair).alias("p"))
    return dealt.select("leader", F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("own").alias("block"), "class", "n", "comp")


def _compare(groups: DataFrame, per_cent: int, exact: bool) -> DataFrame:
    """groups: _grouped() with signature (and with members if exact). All pairs of a block pair are looked at; (a, b): those that link
    if exact, else for each row that may link with any one such pair."""

    def compare(x: pa.RecordBatch) -> list[tuple[int, int]]:
        i, j, block, c, n, comp = (x.column(k).to_numpy() for k in range(1, 7))
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        a, b = (y.ravel() for y in np.meshgrid(left, right, indexing="ij"))
        ok = (comp[a] != comp[b]) & _compatible(n[a], n[b], per_cent)
        if i[0] == j[0]:
            ok &= a < b
        a, b = a[ok], b[ok]
        if not len(a):
            return []
        s = _words(x.column(7))
        ok = _may_link([s[k] for k in a], [s[k] for k in b], n[a], n[b], per_cent)
        a, b = a[ok], b[ok]
        if not exact:
            one = np.concatenate([np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]])
            return list(zip(c[a[one]].tolist(), c[b[one]].tolist(), strict=True))
        members, up, out = _words(x.column(8)), {}, []

        def root(k: int) -> int:
            while (p := up.get(k, k)) != k:
                k = p
            return k

        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            u, v = root(int(comp[p])), root(int(comp[q]))
            if u != v and _links(members[p], members[q], per_cent):  # one link between two components is enough
                up[max(u, v)] = min(u, v)
                out.append((int(c[p]), int(c[q])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for x in t.combine_chunks().to_batches():
                m, i, j = (x.column(k).to_numpy() for k in range(3))
                cuts = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
                found = dict.fromkeys(p for u, v in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if v - u > 1 for p in compare(x.slice(u, v - u)))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            m, i, j = (t.column(k).to_numpy() for k in range(3))
            other = np.flatnonzero((m != m[-1]) | (i != i[-1]) | (j != j[-1]))  # the last group may go on
            tail = int(other[-1]) + 1 if len(other) else 0
            yield from pairs(t.slice(0, tail))
            rest = t.slice(tail)
        if rest is not None:
            yield from pairs(rest)

    columns = ["leader", "i", "j", "block", "class", "n", "comp", "signature", *["members"] * exact]
    return groups.select(*columns).repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, per_cent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id (long), n_shingles, component_id (smallest doc_id reachable over links, itself included).

    A row with a null doc_id links like any other; component_id is null only where no row of a component has an id.

    Rows link when 100 * intersection >= per_cent * union of their sets of distinct shingles of `width` words (A-Z lower-cased; a text of
    fewer words is one shingle). Null, empty and blank texts have empty sets and link with nothing. Equal sets are one class: copies
    are compared once. Repeated doc_ids each come back. Whole texts, exact: no candidate is dropped but by a bound. Equality of shingles is
    equality of 64-bit hashes.
    """
    return _components(docs, per_cent, width, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def without_copies(docs: DataFrame, per_cent: int = 75, width: int = 5) -> DataFrame:
    """Of each component of jaccard_components the rows of its smallest doc_id; where none of its rows has an id, one row.

    Rows with equal doc_id go or stay together. Rows with null doc_id and an empty set link with nothing and all stay.
    """
    found = stage(_components(docs.select("doc_id", "text"), per_cent, width, "doc_id", "text"))
    copies = stage(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    named = docs.where("doc_id is not null").join(copies, "doc_id", "left_anti").select(*docs.columns)
    # of rows with null ids: all with empty sets; and of components without an id the row of least key, then of least content
    nameless = found.where("doc_id is null and component_id is null")
    one = nameless.where("component is not null").groupBy("component").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("one"))
    stay = stage(one.union(nameless.where("component is null").select("key", F.lit(False)).distinct()))
    row = F.struct(*[docs[c] for c in docs.columns])
    rest = docs.where("doc_id is null").select(row.alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key")).join(stay, "key")
    single = rest.where("one").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return named.union(single.select("row.*")).union(rest.where("not one").select("row.*"))


def _components(docs: DataFrame, per_cent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """jaccard_components with key (see _keyed) and component: one of its classes, null for empty sets."""
    rows = stage(_sets(docs, width, per_cent, id_col, text_col, None))
    common = _common(rows)
    if common is not None:
        again = stage(_sets(docs, width, per_cent, id_col, text_col, common))
        drop_staged(rows)
        rows = again
    release(docs.sparkSession)
    signed = stage(rows.where("signature is not null").select("class", "n", "signature").dropDuplicates(["class"]))
    stars = stage(_stars(rows.where("signature is not null").select("class", "n", "first")))
    slim = stage(rows.select("doc_id", "key", "class", "n"))
    drop_staged(rows)
    release(docs.sparkSession)

    # with their leaders
    near = stage(_near_leader(stars, signed, per_cent))
    wanted = near.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    members = _members_of(docs, slim, wanted, width, id_col, text_col)
    components = stage(connected_components(stage(_verify(near, members, per_cent))))
    release(docs.sparkSession)

    # with a leader's other rows, where the leader links one of the two at most
    comp = components.withColumnRenamed("id", "class")
    known = stars.join(comp, "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component")
    known = known.join(comp.withColumnRenamed("class", "leader"), "leader", "left").withColumn("linked", F.col("comp") == F.coalesce("component", "leader"))
    known = stage(known.select("leader", "class", "n", "comp", "linked"))
    close = _compare(_grouped(known, per_cent).join(signed.select("class", "signature"), "class"), per_cent, exact=False)
    close = stage(close.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    if close.isEmpty():
        more = close.select(F.col("class").alias("a"), F.col("class").alias("b"))
    else:
        members = members.union(_members_of(docs, slim, close.join(members, "class", "left_anti"), width, id_col, text_col))
        left = stage(known.join(close, "class", "left_semi"))
        more = stage(_compare(_grouped(left, per_cent).join(signed.select("class", "signature"), "class").join(members, "class"), per_cent, exact=True))
    release(docs.sparkSession)
    if not more.isEmpty():
        # links between components of the first round
        up = components.select(F.col("id"), "component")
        joined = more.join(up.withColumnRenamed("id", "a").withColumnRenamed("component", "ca"), "a", "left").join(up.withColumnRenamed("id", "b").withColumnRenamed("component", "cb"), "b", "left")
        top = connected_components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        ends = components.join(top.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        lone = top.join(components.select("id"), "id", "left_anti").select("id", "component")
        components = stage(ends.union(lone))

    of_class = slim.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")).join(components.withColumnRenamed("id", "class"), "class", "left")
    of_class = of_class.withColumn("component", F.coalesce("component", "class"))
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_class.select("class", "component").join(least, "component").select("class", "component", "component_id")
    return slim.join(named, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "key", "component")


def _members_of(docs: DataFrame, slim: DataFrame, classes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(class, members) of the given classes, staged: from a row of each, found by its key."""
    wanted = stage(slim.join(classes, "class").groupBy("class").agg(F.min("key").alias("key")))
    found = _members(docs, wanted.select("key"), width, id_col, text_col)
    return stage(found.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"]))


def _members(docs: DataFrame, keys: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(class, members) of the rows with the given keys, of rows with one key once a task; members: the sorted hashes, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array([k not in met and not met.add(k) for k in batch.column(1).to_pylist()], pa.bool_()))
            for at in range(0, len(batch), 200):
                sets = [s for s in shingle_sets(batch.column(0).slice(at, 200), width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "members"])

    texts = _keyed(docs, id_col, text_col).join(keys, "key", "left_semi")
    return texts.select("text", "key").mapInArrow(run, "class long, members binary")
