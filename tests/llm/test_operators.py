"""The text operators against brute force, on the given tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import queries
from lattica.llm.common import read_table, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, None, None),
    (2, "", "a", "en"),
    (3, " \n\t ", "a", "en"),
    (4, "one two three four five six", "b", "en"),
    (5, "one two three four five six", "b", "en"),
    (5, "one two three four five six", "b", "en"),
    (6, "x" * 3000, "b", "de"),
    (7, "word " * 4000, "a", "de"),
    (8, "é🙂ß \x1c漢字 don't <|endoftext|> 123,45\r\n\n", None, "fr"),
    (9, "Ünïcode ÀÉ " + "lorem ipsum dolor sit amet " * 40, "c", None),
    (None, "no id at all here", "c", "en"),
    (10, "\U0001f3f4\U000e0067\U000e0062 12 \u2460", "c", "fr"),  # no letter
]
SCHEMA = "doc_id long, text string, source string, lang string"


def rows(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """Name -> folder: the given documents, awkward ones with clashing extra columns, none at all."""
    out = {"given": sf}
    top = tmp_path_factory.mktemp("tables")
    clash = {c: F.lit(7) for c in ("size", "target", "copies", "n_words", "kept", "quality", "n_bytes", "class", "ids", "first", "spans", "_w", "_x_size", "id", "key", "word", "count")}
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns(clash)
    odd.write.parquet(str(top / "odd" / "documents.parquet"))
    odd.where("false").write.parquet(str(top / "empty" / "documents.parquet"))
    return out | {"odd": str(top / "odd"), "empty": str(top / "empty")}


@pytest.fixture(params=["given", "odd", "empty"])
def folder(request, tables):
    return tables[request.param]


def documents(spark, folder):
    return read_table(spark, folder, "documents")


def test_words(spark, folder):
    for r in documents(spark, folder).select("text", word_count(F.col("text")).alias("n")).collect():
        assert r["n"] == len(WORD.findall(r["text"] or ""))


def test_op1(spark, folder):
    docs = rows(documents(spark, folder))
    got = queries.op1_mix_sources(spark, folder).collect()
    assert len(got) == len(docs)
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:  # share by weight, close what is over its cap, share again
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        open_ -= set(over) if over else open_
    by_size = {}
    for s in names:
        by_size.setdefault(sizes[s], set()).add(round(target[s], 6))
    taken, largest = Counter(), Counter()
    for r in got:
        assert round(r["target"], 6) in by_size[r["source_size"]]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"]
        taken[r["source_size"], r["target"]] += r["taken"]
        largest[r["source_size"], r["target"]] = max(largest[r["source_size"], r["target"]], r["size"])
    if len(set(sizes.values())) == len(sizes):
        for k in taken:
            assert abs(taken[k] - k[1]) <= largest[k] / 2 + 1e-6
    again = queries.op1_mix_sources(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pareto_draws_follow_their_probabilities(spark):
    from lattica.llm.mixing import pareto_mix

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    mixed = pareto_mix(docs, F.lit(10), weights=(1,), budget=0.5, importance=F.when(F.col("doc_id") % 2 == 0, 1).otherwise(3))
    low, high = (mixed.where(F.col("doc_id") % 2 == k).agg(F.avg("copies")).first()[0] for k in (0, 1))
    assert abs(low - 0.25) < 0.04 and abs(high - 0.75) < 0.04
    assert mixed.agg(F.sum("copies")).first()[0] == 2000


@pytest.mark.parametrize("ids", ["equal", "null", "both"])
def test_op1_draws_some_of_equal_rows(spark, ids):
    """Sources of a thousand equal rows come as near to their targets as others, and reruns agree."""
    from lattica.llm.mixing import pareto_mix

    doc_id = {"equal": F.lit(7), "null": F.lit(None), "both": F.when(F.col("id") % 2 == 0, 7)}[ids].cast("long")
    docs = spark.range(3000, numPartitions=5).select(doc_id.alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit(1).alias("_torn"), F.lit(2).alias("_salt"))
    out = pareto_mix(docs, F.lit(100))
    assert out.columns == ["doc_id", "source", "_torn", "_salt", "size", "source_size", "target", "copies"]
    got = out.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.count(F.lit(1)).alias("rows"), F.min("copies").alias("low"), F.max("copies").alias("high")).collect()
    assert {r["source"]: r["target"] for r in got} == {"s0": 200_000.0, "s1": 250_000 / 3, "s2": 500_000 / 3}
    assert all(abs(r["taken"] - r["target"]) <= 50 and r["rows"] == 1000 and r["high"] - r["low"] <= 1 for r in got)
    count = lambda df: Counter(map(str, df.collect()))
    assert count(out) == count(pareto_mix(docs, F.lit(100)))


def test_op2(spark, folder):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in queries.op2_quality_rules(spark, folder).collect())
    want = Counter()
    for i, text, _ in rows(documents(spark, folder)):
        text = text or ""
        w = WORD.findall(text)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if seen[x] > 1:
                covered.update(range(k, k + 5))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert got == want


def test_op2_keeps_clean_and_drops_junk(spark, sf):
    judged = [r for r in queries.op2_quality_rules(spark, sf).collect() if not r["base_failed"]]
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, sf, "labels").collect()}
    kept = [(labels[r["doc_id"]], r["kept"]) for r in judged if r["doc_id"] in labels]
    assert all(k for q, k in kept if q == 1)
    bad = [k for q, k in kept if q == 0]
    assert not bad or sum(bad) / len(bad) < 0.3


def test_op2_verdict_by_an_em_over_documents(spark, sf):
    """The same model fitted document by document, in numpy, without vote patterns."""
    from lattica.llm import quality

    names = list(quality.rules())
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    given = quality.with_features(documents(spark, sf)).select("doc_id", base.alias("base"), *[c.cast("int").alias(k) for k, c in quality.rules().items()]).collect()
    votes, base = np.array([[r[k] for k in names] for r in given]), np.array([r["base"] for r in given])
    share, good, bad = 0.85, np.full(len(names), 0.02), np.full(len(names), 0.3)

    def posterior(v):
        score = np.log(share / (1 - share)) + np.where(v == -1, np.log(good / bad), np.where(v == 1, np.log((1 - good) / (1 - bad)), 0)).sum(axis=1)
        return 1 / (1 + np.exp(-score))

    fitted = votes[~base]
    for _ in range(25):
        p, before = posterior(fitted)[:, None], share
        against, for_ = fitted == -1, fitted == 1
        share = float(np.clip((p.sum() + 8.5) / (len(p) + 10), 0.05, 0.995))
        good = np.clip(((against * p).sum(axis=0) + 0.2) / (((against | for_) * p).sum(axis=0) + 10), 1e-4, 0.02)
        bad = np.clip(((against * (1 - p)).sum(axis=0) + 3) / (((against | for_) * (1 - p)).sum(axis=0) + 10), 2 * good, 0.999)
        if abs(share - before) < 1e-7:
            break
    p = posterior(votes)
    want = {r["doc_id"]: (x, not b and x >= 0.5) for r, x, b in zip(given, p.tolist(), base.tolist(), strict=True)}
    for r in queries.op2_quality_rules(spark, sf).collect():
        assert r["quality"] == pytest.approx(want[r["doc_id"]][0], abs=1e-6) and r["kept"] == want[r["doc_id"]][1]


def test_vote_rates_are_found(spark):
    from lattica.llm.quality import fit_votes

    rng = random.Random(5)
    votes = []
    for _ in range(4000):
        good = rng.random() < 0.8
        votes.append(tuple((-1 if rng.random() < (0.01 if good else 0.7) else 1) if rng.random() < 0.9 else 0 for _ in range(4)))
    model = fit_votes(spark.createDataFrame(votes, "a int, b int, c int, d int"), list("abcd"))
    assert abs(model["share"] - 0.8) < 0.03 and all(abs(b - 0.7) < 0.06 and g < 0.03 for g, b in model["bad_rate"].values())


def encoding():
    import tiktoken

    from lattica.llm.bytebpe import load_ranks

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_op3(spark, folder):
    enc, want = encoding(), Counter()
    for i, text, _ in rows(documents(spark, folder)):
        ids = enc.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op3_byte_bpe(spark, folder).collect())
    assert got == want


def test_folds_of_odd_words(spark):
    from lattica.llm.bytebpe import ByteBPE, load_ranks

    enc, rng = encoding(), random.Random(2)
    words = ["".join(rng.choice("aeithnsr") for _ in range(rng.randint(1, 120))) for _ in range(300)] + ["".join(rng.choice("aeithnsr") for _ in range(n)) for n in (255, 256, 257, 400)]
    words += ["a" * k for k in (1, 2, 47, 48, 49, 50, 255, 256, 257, 700)] + ["ñß" * 40, "ñß" * 100, "-" * 300, " " * 10, "ab" * 200, "aab" * 80, "aab" * 100]
    # periods, where pairs of one piece overlap
    words += ["".join(rng.choice(few) for _ in range(rng.randint(2, 50))) for few in ("ab", "a", "-=", " ", "oO", ".", "aé", "\u4e00\u3000") for _ in range(120)]
    words += [(x * 60)[: rng.randint(2, 60)] for x in ("ab", "aba", "abb", "an", "ana", "nan", "ing", "--=", "the", "0", "10", "100", "\u00c3\u0082", "\u2014") for _ in range(12)]
    bpe = ByteBPE(spark, load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    got = bpe.fold(spark.createDataFrame([(w,) for w in words], "word string").repartition(8), "word").collect()
    assert all(r["ids"] == enc._core_bpe.encode_single_piece(r["word"].encode()) for r in got)
    back = bpe.decode(spark.createDataFrame([(r["word"], r["ids"]) for r in got], "word string, ids array<int>")).collect()
    assert all(bytes(r["decoded"]) == r["word"].encode() for r in back)


def test_op4(spark, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    docs = [(i, tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows(documents(spark, folder))]
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, np.array(d[1], "<u2").tobytes()))
    want, start = Counter(), 0
    for i, ids in docs:
        want[i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op4_wavelet_shards(spark, folder).collect()) == want


def test_a_shards_file_answers_without_unpacking(spark, sf):
    from lattica.llm import wavelet

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        encoded, kind = wavelet.encode_documents(documents(spark, sf), f.read(), end_id=2)
    shards = wavelet.write_shards(encoded, kind, shard_tokens=20_000)
    assert len(set(r[0] for r in shards.select(F.input_file_name()).collect())) == shards.count() > 1
    ids = {r["doc_id"]: np.frombuffer(r["ids"], kind) for r in encoded.collect()}
    for row in shards.collect():
        shard = wavelet.Shard(row["file"])
        want = np.concatenate([ids[i] for i in shard.docs.tolist()])
        assert shard.docs.tolist() == sorted(shard.docs.tolist()) and shard.lengths.tolist() == [len(ids[i]) for i in shard.docs.tolist()]
        token = int(want[len(want) // 2])
        at = np.flatnonzero(want == token)
        assert shard.matrix.access(np.array([0, len(want) // 2, len(want) - 1])).tolist() == [want[0], token, want[-1]]
        assert shard.matrix.count(token, 10, 5000) == ((at >= 10) & (at < 5000)).sum() and shard.matrix.select(token, len(at) - 1) == at[-1]


def test_wavelet_answers_unpack_a_block_of_a_plane(monkeypatch):
    from lattica.llm import wavelet

    monkeypatch.setattr(wavelet, "BLOCK", 1 << 10)
    ids = np.random.default_rng(1).integers(0, 500, 100_000).astype(np.uint32)
    shard = wavelet.Shard(wavelet.write_shard(np.arange(1), np.array([len(ids)]), ids))
    assert shard.matrix.access(np.array([77_777])).tolist() == [ids[77_777]] and len(shard.unpacked) == shard.matrix.width
    assert shard.matrix.count(7, 100, 90_000) == (ids[100:90_000] == 7).sum() and len(shard.unpacked) <= 3 * shard.matrix.width
    assert shard.matrix.select(7, 40) == np.flatnonzero(ids == 7)[40] and len(shard.unpacked) <= 6 * shard.matrix.width
    assert (shard.matrix.decode() == ids).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400))
def test_wavelet_matrix(values):
    from lattica.llm.wavelet import Shard, write_shard

    ids = np.array(values, np.uint32)
    m = Shard(write_shard(np.arange(1), np.array([len(ids)]), ids)).matrix
    assert m.decode().tolist() == values
    assert not values or m.access(np.arange(len(ids))).tolist() == values
    for token in [*values[:5], 301, 100_000]:
        at = [k for k, x in enumerate(values) if x == token]
        assert m.count(token) == len(at) and [m.select(token, k) for k in range(len(at) + 1)] == [*at, -1]
        assert m.count(token, 3, max(3, len(ids) // 2)) == sum(3 <= k < max(3, len(ids) // 2) for k in at)


def test_op5(spark, folder):
    from lattica.llm.licenses import TEMPLATES, template_bigrams

    bags = sorted((lic, Counter(b.rsplit(" ", 1)[0] for b in template_bigrams(t))) for lic, ts in TEMPLATES.items() for t in ts)
    got = Counter((r["doc_id"], r["license"], round(r["dice"], 9), r["licenses"], r["n_segments"]) for r in queries.op5_license_scan(spark, folder).collect())
    want = Counter()
    for i, text, _ in rows(documents(spark, folder)):
        text = text or ""
        blocks = re.split(r"\n[\x20\x09-\x0D]*\n", text)
        hits = []
        for seg in dict.fromkeys(text.split("\n") + (blocks if len(blocks) > 1 else []) + [text]):
            w = re.findall(r"[^\W_]+", seg.lower())
            mine = Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))
            if mine:
                best = max(((2 * (mine & b).total() / (mine.total() + b.total()), -k, lic) for k, (lic, b) in enumerate(bags)))
                if best[0] >= 0.8 - 1e-12:
                    hits.append(best)
        top = max(hits, default=(0.0, 0, None))
        want[i, top[2], round(top[0], 9), ",".join(sorted({h[2] for h in hits})), len(hits)] += 1
    assert got == want


def test_op5_finds_whole_licences(spark):
    from lattica.llm.licenses import TEMPLATES, scan

    docs = []
    for lic in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT"):
        lines = re.sub(r"(.{60,75}) ", "\\1\n", TEMPLATES[lic][-1]).replace("1. Redis", "\n\n1. Redis").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
        docs += [(lic, f"The licence\n\nCopyright (c) 2021 Jane Doe\n\n{lines}\n\nThe rest of the readme."), (lic, "/* " + lines.replace("\n", "\n * ") + " */\nint main() { return 0; }\n")]
    got = {r["doc_id"]: r for r in scan(spark.createDataFrame(list(enumerate(t for _, t in docs)), "doc_id long, text string")).collect()}
    assert [got[k]["license"] for k in range(len(docs))] == [lic for lic, _ in docs] and all(r["dice"] > 0.97 for r in got.values())


def test_op5_finds_notices_inside_other_words(spark):
    from lattica.llm.licenses import TEMPLATES, scan, template_bigrams

    apache = TEMPLATES["Apache-2.0"][1]
    one, url, two = apache.partition("http://www.apache.org/licenses/LICENSE-2.0")
    layout = f"{one.strip()}\n\n    {url}\n\n{two.strip()}"
    wrapped = "\n".join("# " + x if x else "#" for x in layout.replace("; ", ";\n").replace(", software", ",\nsoftware").split("\n"))
    docs = {
        1: "Some title\n\nWords before.\n\n" + layout + "\n\nWords after.",
        2: "Copyright (c) 2020 Jane Doe. Licensed under the MIT License.",
        3: wrapped + "\nimport os\nprint(os.name, 'of the')\n" * 9,
        4: "We say: released under the MIT License. And data, this work is licensed under CC BY 4.0, as is " + "more of the text " * 50,
        5: "Released under the MIT License.\nAlso this is released under the MIT License here, and nothing else of the kind is.",
        6: "The license of the software is under the table. This work is under copyright; the rest of the program may use the file.",
        7: "the code (licensed under the MIT) licensed under the licensed under the MIT License " * 2,
    }
    got = {r["doc_id"]: r for r in scan(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert [got[k]["license"] for k in range(1, 7)] == ["Apache-2.0", "MIT", "Apache-2.0", got[4]["license"], "MIT", None]
    assert got[1]["dice"] == got[2]["dice"] == got[3]["dice"] == 1 and got[4]["licenses"] == ["CC-BY-4.0", "MIT"] and got[5]["n_segments"] == 2
    bags = [Counter(b.rsplit(" ", 1)[0] for b in template_bigrams(t)) for ts in TEMPLATES.values() for t in ts]
    for k, text in docs.items():  # no stretch of words is better than what was found
        w = re.findall(r"[^\W_]+", text.lower())
        pairs, top = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)], 0.0
        for bag in bags:
            at = [i for i, p in enumerate(pairs) if p in bag]
            for a in at:
                for b in at:
                    if a <= b < a + 1.5 * bag.total():
                        top = max(top, 2 * (Counter(pairs[a : b + 1]) & bag).total() / (b + 1 - a + bag.total()))
        assert abs(got[k]["dice"] - (top if top >= 0.8 else 0)) < 1e-12, k


def repeats_by_force(texts, length):
    raws = [t.encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    for r in raws:
        gone = np.zeros(len(r) + 1, int)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        yield len(r), int(mask.sum()), int((mask & ~np.concatenate([[False], mask[:-1]])).sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~mask].tobytes()).hexdigest()


@pytest.mark.parametrize("group", [3_000, 3])
def test_op6(spark, folder, group, monkeypatch):
    from lattica.llm import substrings

    monkeypatch.setattr(substrings, "GROUP", group)
    docs = rows(documents(spark, folder))
    want = Counter(zip([d[0] for d in docs], repeats_by_force([d[1] or "" for d in docs], 400), strict=True))
    got = Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in queries.op6_substring_dedup(spark, folder).collect())
    assert got == want


def test_op6_on_edited_copies(spark):
    from lattica.llm.substrings import remove_repeats

    rng = random.Random(4)
    base = "".join(rng.choice("abcdé ") for _ in range(3000))
    texts = [base[rng.randint(0, 900) : rng.randint(1500, 3000)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 300))) for _ in range(25)]
    for k in range(10):
        t = list(base)
        for _ in range(k):
            t[rng.randrange(len(t))] = "Q"
        texts.append("".join(t))
    texts += ["ab" * 900, "c" * 1000, base[:399], base[:400]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in remove_repeats(docs).collect()}
    assert [got[k] for k in range(len(texts))] == list(repeats_by_force(texts, 400))


def test_op6_on_null_ids(spark):
    from lattica.llm.substrings import remove_repeats

    rng = random.Random(6)
    one, two = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (700, 450))
    own = ["".join(rng.choice("pqrstuvw ") for _ in range(500)) for _ in range(6)]
    # a passage that two null ids share; one that a null id shares with an id; a copy of a null id's text; null ids that share nothing
    docs = [(None, own[0] + one), (None, one + own[1]), (None, two + own[2]), (1, own[3] + two + "end"), (None, two + own[2]), (None, own[4]), (2, own[5])]
    docs = [(i, t, k) for k, (i, t) in enumerate(docs)]
    want = dict(enumerate(repeats_by_force([t for _, t, _ in docs], 400)))
    assert want[0][1] >= 700 and want[3][1] >= 450 and want[5][1] == 0
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string, k int").repartition(4)).collect()
    assert {r["k"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got} == want


def test_op6_goes_by_bytes_not_words(spark):
    """A shared passage of over 50 words goes if it has 400 bytes, and stays if it has fewer; n_bytes is the input's size either way."""
    from lattica.llm.substrings import remove_repeats

    rng = random.Random(12)

    def words(n, letters):
        return " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n)) + " "

    short, long = words(60, "abcdef"), words(90, "ghijkl")
    assert len(short.split()) > 50 and len(short) < 400 <= len(long)
    docs = [words(100, "mnop") + short, short + words(100, "qrst"), words(100, "uvwx") + long, long + words(100, "mnqr"), words(100, "stuv")]
    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert [got[k]["n_removed"] for k in range(5)] == [0, 0, len(long), len(long), 0] and [got[k]["n_bytes"] for k in range(5)] == list(map(len, docs))


def test_deep_shallow_sort():
    from lattica.llm.suffixes import deep_shallow_sort

    rng = random.Random(3)
    for _ in range(300):
        base = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 70)))
        strings = [base[: rng.randint(0, len(base))] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 15))]
        assert [strings[k] for k in deep_shallow_sort(strings)] == sorted(strings)


def test_op7(spark, folder):
    got = queries.op7_language(spark, folder).collect()
    docs = {r["doc_id"]: r for r in documents(spark, folder).collect()}
    known = {r["lang"] for r in docs.values() if r["lang"]}
    assert len(got) == documents(spark, folder).count()
    for r in got:
        text = docs[r["doc_id"]]["text"]
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in known | {"und"}
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))


def test_op7_is_right_on_held_out_rows(spark, sf):
    docs = {r["doc_id"]: r["lang"] for r in documents(spark, sf).collect()}
    held = [r for r in queries.op7_language(spark, sf).collect() if r["held_out"] and docs[r["doc_id"]]]
    assert np.mean([docs[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95


def test_mixtures_find_both_languages(spark, sf):
    from lattica.llm.langid import identify, learn

    docs = documents(spark, sf)
    model = learn(docs)
    pure = {lang: " ".join(r["text"] for r in docs.where(F.col("lang") == lang).limit(12).collect()) for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, pure["en"][:3000] + " " + pure["de"][:3000])], "doc_id long, text string")
    found = identify(mixed, *model).first()
    assert {"en", "de"} <= set(found["languages"]) and found["score"] < 0.8


def sets_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_by_force(docs):
    up = {i: i for i, _ in docs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    items = [(i, sets_of(t)) for i, t in docs]
    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            n = len(a & b)
            if n and 100 * n >= 75 * (len(a) + len(b) - n):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in items}


def test_op8(spark, folder):
    docs = [(i, t) for i, t, _ in rows(documents(spark, folder))]
    want = components_by_force([d for d in docs if d[0] is not None])
    got = queries.op8_jaccard_join(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


@pytest.mark.parametrize("common,block", [(48, 256), (2, 3)])
def test_op8_on_edited_copies(spark, common, block, monkeypatch):
    from lattica.llm import jaccard

    monkeypatch.setattr(jaccard, "COMMON_ROWS", common)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(20, 90))] for _ in range(5)]
    passage = [rng.choice(vocab) for _ in range(60)]
    docs = []
    for k in range(160):
        w = list(bases[k % 5])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if k % 7 == 0:
            w = passage + w[: rng.randint(0, 20)]
        docs.append((1000 - k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == components_by_force(docs)


def test_op8_settles_a_large_group_of_near_copies_by_its_leader(spark, monkeypatch):
    """Rows that their leader links are not compared with one another: a group of k near copies takes k comparisons, not k * k."""
    from lattica.llm import jaccard

    rng = random.Random(5)
    vocab = [f"v{k}" for k in range(5000)]
    base = [rng.choice(vocab) for _ in range(200)]
    docs = []
    for k in range(1500):
        w = list(base)
        w[rng.randrange(200)] = f"own{k}"
        docs.append((k, " ".join(w)))
    docs += [(2000 + k, " ".join(rng.choice(vocab) for _ in range(60))) for k in range(300)]
    met, grouped = [], jaccard._grouped

    def counted(*args):
        out = grouped(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_grouped", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    assert all(got[i] == (0 if i < 2000 else i) for i, _ in docs)
    assert sum(met) < 3 * len(docs)


def test_op8_on_null_ids(spark):
    from lattica.llm import jaccard

    rng = random.Random(9)
    base = [[f"{c}{rng.randrange(10**6)}" for _ in range(100)] for c in "abcde"]

    def text(k, *changed):
        return " ".join("changed" if i in changed else w for i, w in enumerate(base[k]))

    # 1 and 2 are linked through a null id's text only; null ids that are near or exact copies of one another; of an id; alone; empty
    docs = [(1, text(0, *range(8))), (None, text(0)), (2, text(0, *range(92, 100)))]
    docs += [(None, text(1)), (None, text(1, 0)), (None, text(1)), (None, text(2, 50)), (3, text(2)), (None, text(3)), (None, ""), (None, None), (4, text(4))]
    force = components_by_force([(k, t) for k, (_, t) in enumerate(docs)])
    least = {}
    for k, (i, _) in enumerate(docs):
        least[force[k][1]] = min((x for x in (i, least.get(force[k][1])) if x is not None), default=None)
    assert force[0][1] == force[2][1] and force[3][1] == force[4][1]
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, key int").repartition(4)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table).collect())
    assert got == Counter((i, force[k][0], least[force[k][1]]) for k, (i, _) in enumerate(docs))

    kept = jaccard.without_copies(table).collect()
    assert sorted(force[r["key"]][1] for r in kept) == sorted(set(c for _, c in force.values()))
    assert {r["key"] for r in kept if r["doc_id"] is not None} == {0, 7, 11} and {8, 9, 10} <= {r["key"] for r in kept}


def test_op9(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    vectors = [(k, (centres[k % 12] + rng.normal(scale=0.25, size=16)).tolist()) for k in range(300)]
    vectors += [(300 + k, vectors[5][1]) for k in range(40)]
    vectors += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [float("inf")] + [1.0] * 15), (405, [None] + [1.0] * 15), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (408, [1e300] * 16), (409, [3e300] * 16)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r for r in queries.op9_embedding_duplicates(spark, str(tmp_path)).collect()}
    good = [(i, np.array(v, float) / max(np.abs(v))) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = Counter(), {i: i for i, _ in vectors}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    assert len(got) == len(vectors)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * links.total() and all(r["n_links"] <= links[i] for i, r in got.items())
    assert np.mean([r["component_id"] == find(i) for i, r in got.items()]) > 0.95
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert queries.op9_embedding_duplicates(spark, str(tmp_path / "none")).count() == 0


def test_op9_on_repeated_and_null_ids(spark):
    from lattica.llm.embeddings import near_duplicates

    one, two, three = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.2, 0.0], [1.0, 0.05, 0.0, 0.1]
    vectors = [(5, one), (5, two), (5, two), (None, one), (3, three), (7, None), (7, two), (8, [0.0, 0.0, 0.0, -1.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit(9) for c in ("id", "key", "rep", "v", "n", "copies", "component", "codes", "signs", "least", "n_links", "kept", "block")})
    got = Counter(tuple(r) for r in near_duplicates(table.repartition(3)).collect())
    # of (5, two) twice and (7, two) each links with two; (5, one) with (3, three); the null id with nothing
    assert got == Counter([(5, 1, 3, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, None), (3, 1, 3, True), (7, 0, 7, True), (7, 2, 5, False), (8, 0, 8, True)])


def test_op9_recall_at_several_bits(spark):
    """Of pairs just above the threshold, at least 0.9 are found; none below it."""
    from lattica.llm.embeddings import near_duplicates, shape

    rng = np.random.default_rng(3)
    base = rng.normal(size=(6000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(2000, 32))
    side -= (side * base[:2000]).sum(axis=1, keepdims=True) * base[:2000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.88, 0.96, size=(2000, 1))
    x = np.concatenate([base, cos * base[:2000] + np.sqrt(1 - cos**2) * side])
    assert shape(len(x), 0.9)[0] >= 8
    near = x @ x.T >= 0.9
    want = near.sum(axis=1) - 1
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(table).collect()}
    assert all(got[k] <= want[k] for k in range(len(x))) and sum(got.values()) >= 0.95 * want.sum()


def test_components(spark):
    from lattica.llm.graph import connected_components

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_op10(spark, folder):
    from lattica.llm.wordpiece import pieces_of

    starts, rests = map(set, pieces_of(public_tokenizers.path("piece_bpe_32k.model")))

    def greedy(word):
        at = n = 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + 40), at, -1) if word[at:e] in (rests if at else starts)), None)
            if end is None:
                return 0
            at, n = end, n + 1
        return n

    want = Counter()
    for i, text, _ in rows(documents(spark, folder)):
        counts = [greedy(w) for w in WORD.findall(text or "")]
        want[i, len(counts), sum(c or 1 for c in counts), sum(not c for c in counts)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_tokens"], r["n_unknown"]) for r in queries.op10_token_counts(spark, folder).collect()) == want


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=8), st.sets(st.text("abc", min_size=1, max_size=4), max_size=8), st.text("abc", max_size=12))
def test_automaton(starts, rests, word):
    from lattica.llm.wordpiece import Automaton

    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (rests if at else starts)), None)
        if end is None:
            n = 0
            break
        at, n = end, n + 1
    assert Automaton(starts, rests).count(word) == n


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(name, spark, sf, duck):
    from tests.test_queries import same

    same(queries.queries()[name](spark, sf).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


def test_op3_bins_of_words(spark):
    """Within the bins, for negative hashes too, and dealt evenly."""
    from lattica.llm.bytebpe import WORD_BINS, word_bin

    bins = [r["b"] for r in spark.range(5000).select(word_bin(F.concat(F.lit("é"), F.col("id").cast("string"))).alias("b")).collect()]
    assert all(0 <= b < WORD_BINS for b in bins) and len(set(bins)) > 4800


def test_op3_small_dictionary(spark):
    """A small dictionary is a small row, however many bins the largest one has; its bound and the columns asked for change no ids."""
    from lattica.llm.bytebpe import DICTIONARY_WORDS, WORD_BINS, ByteBPE, bins_for, load_ranks

    assert bins_for(DICTIONARY_WORDS) == WORD_BINS and [bins_for(n) for n in (0, 1, 2, 5, 100_000)] == [1, 1, 1, 2, 1 << 15]
    texts = [" ".join(f"w{j % 40} é{j % 7}" for j in range(k)) for k in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc, bpe = encoding(), ByteBPE(spark, load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    known = bpe.dictionary(docs, most=64).first()["known"]
    assert len(known) == 32 and {w: i for b in known for w, i in b.items()} and all(i == enc.encode_ordinary(w) for b in known for w, i in b.items())
    for words in (64, 2):
        coded = bpe.encode(docs, dictionary_words=words, id_bytes=False)
        assert coded.columns == ["doc_id", "text", "ids", "decoded"]
        for r in coded.collect():
            assert r["ids"] == enc.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
