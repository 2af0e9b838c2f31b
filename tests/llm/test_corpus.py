"""Centroid clustering, source divergence and language-model scores against brute force, on the given tables and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lattica.llm import attention, queries
from lattica.llm.ballmeans import Balls, ball_kmeans
from lattica.llm.common import read_table
from lattica.llm.divergence import share, source_divergence
from tests.llm.test_operators import ODD, SCHEMA, tables  # noqa: F401

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(params=["given", "odd", "empty"])
def folder(request, tables):  # noqa: F811
    return tables[request.param]


def kmeans_by_force(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    far = [(i, v) for i, v in kept if max(map(abs, v)) >= 1 << 26]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) < 1 << 26]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]
    centroids = [v for _, v in first]
    for left in range(rounds, -1, -1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if left:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == j]
                if mine:
                    centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return Counter((i, j, d) for (i, _), (d, j) in zip(kept, found, strict=True)) + Counter((i, None, None) for i, _ in far) if centroids else Counter((i, None, None) for i, _ in far), centroids


def test_op11(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in read_table(spark, sf, "embeddings").collect()]
    want, centroids = kmeans_by_force(rows, 8, 10, 64)
    got = queries.op11_ball_kmeans(spark, sf).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    for r in got:
        assert r["inertia"] == sum(d * n for (_, _, d), n in want.items())
        assert r["cluster_inertia"] == sum(d * n for (_, j, d), n in want.items() if j == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_op11_on_awkward_vectors(spark, tmp_path):
    """Ties, copies, repeated and null ids, odd lengths and components, vectors out of range, clashing columns; few vectors; none."""
    rng = random.Random(5)
    schema = "vec_id long, embedding array<float>, cluster int, distance long, v int, id string, sums int"
    rows = [(i, [float(rng.randint(-2, 2)) / 1024 for _ in range(4)]) for i in range(60)]
    rows += [(60, [0.0] * 4), (60, [1.0] * 4), (None, [0.5] * 4), (None, [-0.5] * 4), (61, None), (62, []), (63, [1.0] * 3), (64, [1.0, None, 1.0, 1.0]), (65, [float("nan")] * 4), (66, [float("inf")] * 4), (67, [1e30, 0.0, 0.0, 0.0]), (68, [0.0] * 4)]
    for some in (rows, rows[:3], rows[-1:], rows[60:62], rows[64:70], []):
        df = spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in some], schema)
        got, centroids = ball_kmeans(df, k=5, rounds=6, dims=4)
        want, expected = kmeans_by_force([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in some], 5, 6, 4)
        assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == want and centroids == expected
    spark.createDataFrame([], schema).select("vec_id", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.op11_ball_kmeans(spark, str(tmp_path)).count() == 0


def test_op11_cores_meet_no_other_centroid(spark):
    """A member nearer than half the way to any other centroid is settled by its own distance; an unmoved ball isn't looked at."""
    balls = Balls([[0, 0], [100, 0], [0, 1000]])
    asked = []
    inner = Balls.distance
    balls.distance = lambda v, k: asked.append((k, len(v))) or inner(balls, v, k)
    v = np.array([[1, 0], [49, 0], [50, 0], [51, 0], [99, 0]])
    cluster, distance = balls.assign(v, np.array([0, 0, 0, 0, 1]), np.zeros(5, np.int64))
    assert cluster.tolist() == [0, 0, 0, 1, 1] and distance.tolist() == [1, 2401, 2500, 2401, 1]
    assert asked == [(0, 4), (1, 2), (1, 1)]  # of ball 0 only the two at or beyond 50 meet centroid 1, none meets centroid 2
    after = Balls([[0, 0], [100, 0], [0, 2000]], balls, {0: 2500, 1: 2401})
    assert after.still.tolist() == [True, True, False]


def divergence_by_force(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, source, lang in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -f, k) for k, (f, item) in enumerate(items, 1)}
    return out


def found(df):
    return Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_op12(spark, folder):
    docs = [tuple(r) for r in read_table(spark, folder, "documents").select("doc_id", "text", "source", "lang").collect()]
    assert found(queries.op12_source_divergence(spark, folder)) == Counter(divergence_by_force(docs, 30, 50))


def test_op12_on_small_bounds(spark):
    """Few documents a term, ties in rank, many tiles and bands of sources, flushes in the middle."""
    rng = random.Random(3)
    rows = [*ODD, *((100 + k, " ".join(rng.choice(["aa", "Bb", "cc", "dd", "éé", "É", "z"]) for _ in range(rng.randint(0, 9))), f"s{rng.randint(0, 12)}", rng.choice(["en", "fr", None])) for k in range(200))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("term", "n", "g", "v", "of", "docs")})
    want = Counter(divergence_by_force(rows, 2, 3))
    for bounds in ({}, {"tile": (4, 2)}, {"tile": (3, 1000), "held_terms": 3}, {"held_heads": 1}):
        assert found(source_divergence(docs, least_docs=2, top=3, **bounds)) == want


def test_shares_are_exact():
    rng = random.Random(1)
    of = np.array([rng.randint(1, 1 << rng.randint(1, 52)) for _ in range(2000)])
    count = np.array([rng.randint(0, int(b)) for b in of])
    assert share(count, of).tolist() == [1 + 10**9 * a // b for a, b in zip(count.tolist(), of.tolist(), strict=True)]


def test_op13(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text").collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    tokens = [(r["doc_id"], r["text"] or "", [*WORD.findall((r["text"] or "").encode().lower()), None]) for r in docs]
    c = Counter(t for d, _, ts in tokens if not out(d) for t in ts)
    n, v = sum(c.values()), len(c)
    got = queries.op13_lm_scores(spark, folder).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == Counter((d, out(d), len(ts), sum(c[t] > 0 for t in ts), n) for d, _, ts in tokens)
    want = sorted((d is None, d, len(ts), sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)) for d, _, ts in tokens)
    have = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["base_score"]) for r in got)
    assert [w[:3] for w in want] == [h[:3] for h in have] and np.allclose([w[3] for w in want], [h[3] for h in have], rtol=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_op13_other_words_are_joined(spark):
    """With a table of two frequent words the counts of all others come by the join."""
    rows = [(k, f"the the of word{k % 7} WORD{k % 3} {'long' * 20}", "a", "en") for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
        cutter = attention.Cutter(f.read(), public_tokenizers.PATTERN)
    held = F.col("doc_id") % 5 == 0
    whole = attention.score_texts(docs, held, cutter).orderBy("doc_id").collect()
    fewer = attention.score_texts(docs, held, cutter, frequent_words=2).orderBy("doc_id").collect()
    assert [r[:5] for r in whole] == [r[:5] for r in fewer] and np.allclose([r["base_score"] for r in whole], [r["base_score"] for r in fewer])


def small_model(seed=0):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
        cutter = attention.Cutter(f.read(), public_tokenizers.PATTERN)
    rng = np.random.default_rng(seed)
    totals = np.zeros(cutter.size + 1, np.int64)
    totals[:3000] = rng.integers(1, 1000, 3000)
    vocabulary = attention.Vocabulary(totals, cutter, 50)
    direct = attention.direct_path(rng.integers(0, 5, (attention.ROWS, attention.HEAD)), vocabulary.of_class)
    return vocabulary, attention.Model(direct, vocabulary.within), rng


def log_probability(vocabulary, model, ids):
    rows, cls, extra = vocabulary.windows(ids)
    return (model.log_probability(rows, cls) + extra).ravel()[: len(ids)]


def test_op13_gradient():
    """The way back against differences of the way there, in every weight matrix."""
    vocabulary, model, rng = small_model()
    rows, cls, _ = vocabulary.windows(rng.integers(0, 3000, 200).astype("<u4"))
    model = attention.Model(model.direct, vocabulary.within, model.weights)
    for name in model.SHAPES:  # in double precision
        setattr(model, name, getattr(model, name).astype(float))
    g = model.gradient(rows, cls)
    loss = lambda: -model.log_probability(rows, cls).sum() / (cls >= 0).sum()
    at = 0
    for name, shape in model.SHAPES.items():
        w, size = getattr(model, name).reshape(-1), int(np.prod(shape))
        setattr(model, name, w.reshape(shape))
        for k in np.argsort(-np.abs(g[at : at + size]))[:3]:
            old = w[k]
            w[k] = old + 1e-4
            up = loss()
            w[k] = old - 1e-4
            down = loss()
            w[k] = old
            assert abs((up - down) / 2e-4 - g[at + k]) < 2e-3 * max(abs(g[at + k]), 1e-2), name
        at += size


def test_op13_learns_from_every_window(spark):
    """By default each window of a text is learnt from, once; rounds that leave windows out are refused."""
    vocabulary, model, rng = small_model()
    for size in (1, 48, 49, 700, 5000):
        ids = rng.integers(0, 3000, size).astype(vocabulary.kind)
        n = len(vocabulary.windows(ids)[0])
        met = [k for r in range(attention.ROUNDS) for k in range(n)[attention.windows_of_round(ids.tobytes(), r)]]
        assert sorted(met) == list(range(n))
        every = [vocabulary.windows(ids, attention.windows_of_round(ids.tobytes(), r))[1] for r in range(attention.ROUNDS)]
        assert sum((c >= 0).sum() for c in every) == size
    with pytest.raises(ValueError, match="leave windows out"):
        attention.trained(spark.createDataFrame([], "ids binary"), vocabulary, model.direct, rounds=2, every=16)


def test_op13_is_a_causal_distribution():
    """A token's probability doesn't change with later ones, windows score each token once, and the probabilities of all next tokens sum to 1."""
    vocabulary, model, rng = small_model(1)
    ids = rng.integers(0, 3000, 150).astype("<u4")
    whole = log_probability(vocabulary, model, ids)
    for cut in (1, 47, 48, 49, 100):
        assert np.allclose(log_probability(vocabulary, model, ids[:cut]), whole[:cut], atol=1e-4)
    rows, _, _ = vocabulary.windows(ids)
    last = (len(ids) - 1) % attention.STEP
    every = np.arange(len(vocabulary.row))
    total = 0.0
    for part in np.array_split(every, 60):
        cls = np.full((len(part), attention.STEP), -1, np.int32)
        cls[:, last] = vocabulary.cls[part]
        got = model.log_probability(np.repeat(rows[-1:], len(part), axis=0), cls)[:, last] + vocabulary.share[part]
        total += np.exp(got).sum()
    assert abs(total - 1) < 1e-4


def test_op13_positions_meet_few_classes():
    """A position is held against the groups and its own group's classes only; without the layer the two steps give what the pair counts say."""
    vocabulary, model, rng = small_model(2)
    rows, cls, _ = vocabulary.windows(rng.integers(0, 3000, 700).astype("<u4"))
    late = rows[:, attention.LEAD :].ravel()
    order, met, head, tail = model.outputs(rng.random((late.size, attention.WIDTH), np.float32), late, cls.ravel())
    assert len(order) == 700 and len(order) - met == (cls >= attention.HEAD - 1).sum() > 100
    assert sum(x.size for x in head.logits) <= 700 * attention.HEAD // 8 and sum(x.size for x in tail.logits) <= (700 - met) * attention.TAIL // 8
    plain = attention.Model(model.direct, vocabulary.within, np.zeros(model.SIZE))
    flat = cls.ravel()
    want = model.direct[late, np.clip(flat, 0, attention.HEAD - 1)] + np.where(flat >= attention.HEAD - 1, vocabulary.within[np.maximum(flat - (attention.HEAD - 1), 0)], 0)
    assert np.allclose(plain.log_probability(rows, cls).ravel(), np.where(flat >= 0, want, 0), atol=1e-4)


def test_op13_out_of_reach_of_exp():
    """Weights far too large give probabilities still, and no slope that isn't finite."""
    vocabulary, model, rng = small_model(3)
    rows, cls, _ = vocabulary.windows(rng.integers(0, 3000, 150).astype("<u4"))
    for times in (1, 4, 12):
        far = attention.Model(model.direct, vocabulary.within, model.weights * times)
        found = far.log_probability(rows, cls)
        assert np.isfinite(found).all() and found.max() <= 1e-5 and np.isfinite(far.gradient(rows, cls)).all()


def test_op13_groups_are_alike():
    rng = np.random.default_rng(4)
    kind = rng.permutation(np.repeat(np.arange(8), 16))
    found = kind[attention.alike(rng.random((8, 40))[kind] + 0.01 * rng.random((128, 40)), 16)].reshape(8, 16)
    assert (found == found[:, :1]).all()
    vocabulary, _, rng = small_model(5)
    old, counts, pairs = vocabulary.cls, vocabulary.of_class, rng.integers(0, 5, (attention.ROWS, attention.HEAD))
    got, head = vocabulary.arrange(pairs), attention.HEAD - 1
    assert sorted(set(vocabulary.cls)) == sorted(set(old)) and ((vocabulary.cls >= head) == (old >= head)).all()
    assert (got[:, np.minimum(vocabulary.cls, head)] == pairs[:, np.minimum(old, head)]).all() and (vocabulary.of_class[np.minimum(vocabulary.cls, head)] == counts[np.minimum(old, head)]).all()


def test_op13_learns(spark):
    """On held-out texts that follow a pattern the model is far better than the counts of words, and better than without attention."""
    rng = random.Random(2)
    pool = ["red", "green", "blue", "old", "new", "cold", "warm", "tall", "river", "stone", "house", "cloud", "small", "quick", "dark", "light"]
    texts = [" ".join(f"{a} {b} {a}," for a, b in ((rng.choice(pool), rng.choice(pool)) for _ in range(120))) for _ in range(600)]
    docs = spark.createDataFrame([(k, t, "a", "en") for k, t in enumerate(texts)], SCHEMA)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
        cutter = attention.Cutter(f.read(), public_tokenizers.PATTERN)
    held = attention.score_texts(docs, F.col("doc_id") % 10 == 0, cutter, every=1, rounds=6).where("held_out").collect()
    tokens = sum(r["n_tokens"] for r in held)
    base, score = (sum(r[c] for r in held) / tokens for c in ("base_score", "score"))
    assert score > base + 0.15 and all(r["score"] > r["base_score"] for r in held)
