"""The pipeline's stages against brute force."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lattica.llm import queries
from lattica.llm.common import read_table, stage
from tests.llm.test_operators import SCHEMA, WORD, components_by_force, encoding, repeats_by_force

ODD = [
    (1, None, "a", "en", 0),
    (2, "", "a", "en", 0),
    (3, " ".join(f"w{k}" for k in range(60)), "a", "en", 1),
    (4, " ".join(f"w{k}" for k in range(60)), None, "en", 1),
    (5, " ".join(f"é{k}" for k in range(200)), None, None, 1),
    (5, " ".join(f"é{k}" for k in range(200)), None, None, 1),
    (6, "other start " + " ".join(f"é{k}" for k in range(60, 200)) + " and " + " ".join(f"v{k}" for k in range(300)), "b", "fr", 1),
    (None, " ".join(f"u{k}" for k in range(40)), "b", "fr", 1),
]


@pytest.fixture(scope="module", params=["given", "odd", "empty"])
def inputs(request, spark, sf):
    if request.param == "given":
        return read_table(spark, sf, "documents")
    odd = spark.createDataFrame(ODD, SCHEMA + ", n_chars long").withColumns({"row": F.lit(1), "n_words": F.lit(2), "kept": F.lit(3), "copies": F.lit(4), "left": F.lit(5)})
    return odd if request.param == "odd" else odd.where("false")


def test_stages(spark, inputs):
    columns, docs = inputs.columns, stage(inputs)
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, ""))
        before, after = docs.collect(), out.collect()
        if name != "byte_bpe":
            assert out.columns == columns
        if name == "quality_rules":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and all(len(WORD.findall(r["text"])) >= 10 for r in after)
            assert not Counter(map(str, after)) - Counter(map(str, before))
        elif name == "ngram_jaccard_join":
            force = components_by_force([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])
            assert Counter(map(str, after)) == Counter(str(r) for r in before if r["doc_id"] is None or force[r["doc_id"]][1] == r["doc_id"])
        elif name == "suffix_array_dedup":
            want = {r["doc_id"]: (n, gone) for r, (n, gone, _, _) in zip(before, repeats_by_force([r["text"] for r in before], 400), strict=True)}
            assert len(after) == len(before)
            for r in after:
                n, gone = want[r["doc_id"]]
                assert n - gone - 6 * (gone > 0) * 20 <= len(r["text"].encode()) <= n - gone and r["n_chars"] == (len(r["text"]) if gone else r["n_chars"])
        elif name == "mix_sources":
            taken, sizes = Counter(), Counter()
            for r in before:
                sizes[r["source"]] += len(WORD.findall(r["text"]))
            for r in after:
                taken[r["source"]] += len(WORD.findall(r["text"]))
            assert max(Counter(map(str, after)).values(), default=0) <= 2 * max(Counter(map(str, before)).values(), default=1)
            assert all(taken[s] <= 2 * sizes[s] for s in taken)
            total, largest = sum(sizes.values()), max((len(WORD.findall(r["text"])) for r in before), default=0)
            assert abs(sum(taken.values()) - 1.5 * total) <= largest / 2 * len(sizes) + 1
        else:
            enc = encoding()
            assert Counter((r["doc_id"], tuple(r["ids"])) for r in after) == Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"]))) for r in before)
        docs = out


def test_run(spark, sf):
    """run() is its stages one after another, each of which test_stages holds against brute force; and its rows say what they are of."""
    docs = read_table(spark, sf, "documents")
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf))
        if name == "mix_sources":
            texts = docs
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"]
    rows = out.collect()
    assert rows and Counter(map(str, rows)) == Counter(map(str, docs.collect()))
    enc = encoding()
    want = Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in texts.collect())
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in rows) == want and all(len(r["ids"]) == r["n_tokens"] for r in rows)


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {k[: k.index("_") + 1] for k in names if k.startswith("op")} and "pipeline" in names
    assert set(queries.queries()) <= names
