"""Byte-level BPE in Spark higher-order functions.

A word's bytes become an array of ids; a fold merges, as often as it can, the neighbouring pair whose joint rank
is lowest, looked up in a literal table of pairs and ranks (a piece's rank is its id). Frequent words are encoded once and remembered in a
dictionary of bounded size; any other word is folded where it stands, so the dictionary's bound changes the cost only.
Decoding looks up each id's bytes and concatenates them.

Tables and dictionary are one staged row each, which a plan takes in as a constant by a scalar subquery: tasks get them as packed
arrays and maps, and the driver plans without them.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import let, release, stage

#: Words in the dictionary at most, and bytes of such a word at most: what is sent to every task stays below 80 MB.
DICTIONARY_WORDS = 600_000
DICTIONARY_BYTES = 40
#: Words of up to so many bytes are folded a merge at a time; in longer ones a step merges all places of the lowest pair.
SHORT = 256
#: Spark searches a map from end to end, so the words are dealt over bins by hash. A power of two; so many for DICTIONARY_WORDS words.
WORD_BINS = 1 << 18


def bins_for(words: int) -> int:
    """A bin for two to four words of a full dictionary: each bin is a map of its own, and even an empty one takes 32 bytes of the driver and of each task."""
    return 1 << max(0, (words // 2).bit_length() - 1)


def word_bin(word: Column, bins: int = WORD_BINS) -> Column:
    """An int from two cheap steps: functions in lambdas are interpreted, a CRC would take a copy of the bytes, a division and a cast a word."""
    return F.hash(word).bitwiseAND(bins - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Slots of the two halves of the pair table; a pair has one slot in either and sits in one of them. Primes.
SLOTS = (250_007, 130_003)
#: Stands before and after a word's ids, so that each pair of ids has neighbours. No piece has it, and no pair with it is in the table.
EDGE = 65_535
#: Joint ranks are below; what the table gives for other pairs is not.
NONE = 65_536


def pair_table(ranks: dict[bytes, int]) -> list[int]:
    """All pairs of pieces that make a piece, as first << 32 | second << 16 | joint rank, each at its number modulo the slots of a half."""
    halves: list[list[int | None]] = [[None] * n for n in SLOTS]
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is None or b is None:
                continue
            entry, side = a << 32 | b << 16 | rank, 0
            for _ in range(500):  # whoever sits there moves to its slot in the other half
                at = (entry >> 16 << 16) % SLOTS[side]
                entry, halves[side][at] = halves[side][at], entry
                if entry is None:
                    break
                side = 1 - side
            else:
                raise ValueError("the pair table is too small for this vocabulary")
    return [EDGE << 32 | EDGE << 16 if x is None else x for half in halves for x in half]


def _with_constants(df: DataFrame, constants: list[Column], make: Callable[..., Column]) -> DataFrame:
    """df with the fields of the struct that is made from constants, which scalar subqueries give. Higher-order functions take no subquery as
    written, so each is a column first, used once, which the optimiser then puts in place: rows don't carry it."""
    names = [f"_{uuid.uuid4().hex}" for _ in range(len(constants) + 1)]

    def bind(known: list[Column]) -> Column:
        return make(*known) if len(known) == len(constants) else let(F.col(names[len(known)]), lambda c: bind([*known, c]))

    out = df.select("*", *[c.alias(k) for c, k in zip(constants, names, strict=False)]).select(*[df[c] for c in df.columns], bind([]).alias(names[-1]))
    new = out.schema[names[-1]].dataType.names
    return out.select(*[c for c in df.columns if c.lower() not in new], f"{names[-1]}.*")


def _bytes_of(ids: Column, pieces: Column) -> Column:
    """The pieces of ids one after another. A piece is text with a character for each byte, which joins faster than binary values."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")


class ByteBPE:
    """ranks: piece -> rank, with every single byte; a piece's rank is its id; below 65,535. pattern: what matches is encoded by itself.

    The pattern is read by Java with Unicode classes on, whose letters and numbers are those of the JVM's Unicode version. Columns of
    the results' names are replaced.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) >= EDGE:
            raise ValueError("ids have to be below 65,535")
        self.pattern = "(?U)" + pattern
        by_id = {i: b for b, i in ranks.items()}
        top = max(by_id) + 1
        tables = {
            "pairs": pa.array([pair_table(ranks)], pa.list_(pa.int64())),
            "first": pa.array([[ranks.get(bytes([a, b]), NONE) << 16 | ranks[bytes([a])] for a in range(256) for b in range(256)]], pa.list_(pa.int64())),
            "last": pa.array([[NONE << 16 | ranks[bytes([b])] for b in range(256)]], pa.list_(pa.int64())),
            "pieces": pa.array([[by_id.get(i, b"").decode("latin-1") for i in range(top)]], pa.list_(pa.string())),
            "ids": pa.array([[i.to_bytes(4, "little").decode("latin-1") for i in range(top)]], pa.list_(pa.string())),
        }
        row = stage(spark.createDataFrame(pa.table(tables)))
        self.pieces, self.ids = row.select("pieces").scalar(), row.select("ids").scalar()
        self.merges = [row.select(c).scalar() for c in ("pairs", "first", "last")]

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), 0)

    def fold(self, df: DataFrame, word_col: str) -> DataFrame:
        """df with `ids` of each row's word (array<int>)."""
        return _with_constants(df, self.merges, lambda *m: F.struct(self._fold(df[word_col], m).alias("ids")))

    def _fold(self, word: Column, merges: tuple[Column, ...]) -> Column:
        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # a character for each byte
        return let(F.transform(F.split(latin, ""), F.ascii), lambda codes: self._fold_bytes(codes, *merges))

    def _fold_bytes(self, codes: Column, pairs: Column, first: Column, last: Column) -> Column:
        """Ids of a word's bytes. Folded over its ids between two edges, each below its joint rank with the next: rank << 16 | id. A merge
        asks for two new ranks.

        The least of these is the lowest pair, and the leftmost among pairs of the same ids. Pairs of one joint piece cut at
        different places are merged in the order of their ids, not from the left: in a vocabulary made by merging, they don't
        overlap, and so both are merged in any order.
        """
        edge, rest = F.array(F.lit(NONE << 16 | EDGE)), F.lit(1 << 30)
        start = F.flatten(F.array(edge, F.transform(F.slice(codes, 2, F.size(codes) - 1), lambda b, i: F.get(first, F.get(codes, i) * 256 + b)), F.array(F.get(last, F.element_at(codes, -1))), edge))

        def ranked(a: Column, b: Column) -> Column:
            """a with its joint rank with b. What differs from the pair in a slot is the rank, or above any rank."""

            def rank(pair: Column) -> Column:
                return F.least(F.lit(NONE), *[F.get(pairs, (pair % n + k * SLOTS[0]).cast("int")).bitwiseXOR(pair) for k, n in enumerate(SLOTS)])

            return let(a * (1 << 32) + b * (1 << 16), rank) * (1 << 16) + a

        def id_of(x: Column) -> Column:
            return x.bitwiseAND(EDGE)

        def step(s: Column, merge: Callable[[Column, Column, Column], Column]) -> Column:
            """s with the lowest pair merged; as it is when no pair makes a piece."""
            return let(F.array_min(s), lambda m: F.when(m >= NONE << 16, s).otherwise(let(F.shiftright(m, 16), lambda low: merge(s, m, low))))

        def leftmost(s: Column, m: Column, low: Column) -> Column:
            def merged(at: Column) -> Column:
                new = F.array(ranked(id_of(F.get(s, at - 2)), low), ranked(low, id_of(F.get(s, at + 1))))
                return F.flatten(F.array(F.slice(s, F.lit(1), at - 2), new, F.slice(s, at + 2, rest)))

            return let(F.array_position(s, m).cast("int"), merged)

        def everywhere(s: Column, m: Column, low: Column) -> Column:
            def starts(hits: Column) -> Column:  # of hits side by side, which overlap, every second one counts
                runs = F.transform(hits, lambda x, k: x - k)
                return F.filter(hits, lambda x, k: (k + 1 - F.array_position(runs, x - k)) % 2 == 0)

            def merged(at: Column) -> Column:
                ids = F.filter(F.transform(s, lambda x, i: F.when(F.array_contains(at, i), low).when(~F.array_contains(at, i - 1), id_of(x))), lambda x: x.isNotNull())
                return let(ids, lambda new: F.transform(new, lambda x, i: ranked(x, F.coalesce(F.get(new, i + 1), F.lit(EDGE)))))

            hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.shiftright(F.get(s, i), 16) == low)
            return let(hits, lambda h: let(starts(h), merged))

        def run(merge: Callable[[Column, Column, Column], Column]) -> Column:
            end = F.aggregate(F.slice(codes, 2, F.size(codes)), start, lambda s, _: step(s, merge))
            return let(end, lambda e: F.transform(F.slice(e, 2, F.size(e) - 2), lambda x: id_of(x).cast("int")))

        return F.when(F.size(codes) <= SHORT, run(leftmost)).otherwise(run(everywhere))

    def dictionary(self, texts: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS) -> DataFrame:
        """One row, staged: `known`, the ids of the words that most documents hold by word, in bins by hash.

        Counts cover all texts. The cut is the least document count for which the words that reach it are within the bound,
        found on a histogram of counts with 64 bins, so the row's size is bounded for certain.
        """
        counts = stage(
            texts.select(F.explode(F.array_distinct(self.words(F.col(text_col)))).alias("word"))
            .where(F.octet_length("word") <= DICTIONARY_BYTES)
            .groupBy("word")
            .count()
            .where(F.col("count") > 1)
            .withColumn("level", F.floor(F.log2("count") * 4).cast("int"))
        )
        level, total = 1 << 30, 0
        for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # a row for each quarter of a power of two
            if (total := total + row["count"]) > most:
                break
            level = row["level"]
        head = self.fold(counts.where(F.col("level") >= level).select(word_bin(F.col("word"), bins_for(most)).alias("bin"), "word"), "word")
        every = texts.sparkSession.range(bins_for(most)).select(F.col("id").cast("int").alias("bin"))
        bins = every.join(head.groupBy("bin").agg(F.collect_list(F.struct("word", "ids")).alias("entries")), "bin", "left")
        packed = F.sort_array(F.collect_list(F.struct("bin", "entries")))
        empty = F.array().cast("array<struct<word:string,ids:array<int>>>")
        return stage(bins.agg(packed.alias("bins")).select(F.transform("bins", lambda x: F.map_from_entries(F.coalesce(x["entries"], empty))).alias("known")))

    def encode(self, docs: DataFrame, text_col: str = "text", dictionary_words: int = DICTIONARY_WORDS, id_bytes: bool = True) -> DataFrame:
        """docs with each text's `ids` (array<int>), `id_bytes` (binary: ids as little-endian unsigned 32-bit integers; only if asked for) and
        `decoded` (binary: what the ids stand for). Null and empty texts have none. Reads the texts twice: for the dictionary first.
        dictionary_words bounds the memory of driver and tasks (some 100 bytes a word) and changes the cost only."""
        bytes_of = {"id_bytes": self.ids} if id_bytes else {}
        bytes_of["decoded"] = self.pieces
        known = self.dictionary(docs, text_col, dictionary_words)
        release(docs.sparkSession)  # the driver's copies of what the dictionary's plans took in, before it makes others

        def coded(known: Column, *rest: Column) -> Column:
            merges, tables = rest[: len(self.merges)], dict(zip(bytes_of, rest[len(self.merges) :], strict=True))

            def of(word: Column) -> Column:
                return F.coalesce(F.try_element_at(F.get(known, word_bin(word, bins_for(dictionary_words))), word), self._fold(word, merges))

            ids = F.flatten(F.transform(self.words(docs[text_col]), of))
            return let(ids, lambda i: F.struct(i.alias("ids"), *[_bytes_of(i, t).alias(c) for c, t in tables.items()]))

        return _with_constants(docs, [known.scalar(), *self.merges, *bytes_of.values()], coded)

    def decode(self, coded: DataFrame, ids: str = "ids") -> DataFrame:
        """A table's rows with `decoded` (binary): the bytes that ids stand for."""
        return _with_constants(coded, [self.pieces], lambda piece_bytes: F.struct(_bytes_of(coded[ids], piece_bytes).alias("decoded")))
