"""The queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from hashlib import sha256

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import read_table, stage, word_count


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(*columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.mixing import pareto_mix

    sized = stage(documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = pareto_mix(sized, F.col("size"), weights=(3, 1, 2), budget=1.5, max_copies=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.quality import judge_quality

    judged = judge_quality(documents(spark, sf_dir, "doc_id", "text"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.bytebpe import ByteBPE, load_ranks

    docs = documents(spark, sf_dir, "doc_id", "text")
    bpe = ByteBPE(spark, load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    coded = bpe.encode(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.wavelet import encode_documents, read_shards, write_shards

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        encoded, kind = encode_documents(documents(spark, sf_dir, "doc_id", "text"), f.read(), end_id=2)
    return read_shards(write_shards(stage(encoded, compression="uncompressed"), kind), with_ids=False)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.licenses import scan

    found = scan(documents(spark, sf_dir, "doc_id", "text"))
    return found.withColumns({"dice": F.round("dice", 9), "licenses": F.array_join("licenses", ",")})


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.substrings import remove_repeats

    cut = remove_repeats(documents(spark, sf_dir, "doc_id", "text"), length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.langid import identify, learn

    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = identify(docs, *learn(docs.where(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.jaccard import jaccard_components

    return jaccard_components(documents(spark, sf_dir, "doc_id", "text"), per_cent=75, width=5)


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.embeddings import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.wordpiece import pieces_of, token_counts

    return token_counts(documents(spark, sf_dir, "doc_id", "text"), *pieces_of(public_tokenizers.path("piece_bpe_32k.model")))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.ballmeans import ball_kmeans

    assigned, centroids = ball_kmeans(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, rounds=10, dims=64)
    digests = [(k, sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    per = stage(assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")), files=1)  # a row per cluster
    per = per.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster").withColumn("inertia", per.agg(F.try_sum("cluster_inertia")).scalar())
    return assigned.join(F.broadcast(per), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.divergence import source_divergence

    return source_divergence(documents(spark, sf_dir, "text", "lang", "source"), least_docs=30, top=50).drop("q")


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.attention import Cutter, score_texts

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
        cutter = Cutter(f.read(), public_tokenizers.PATTERN)
    return score_texts(documents(spark, sf_dir, "doc_id", "text"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0, cutter)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_COMPONENTS = "reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a), comp AS (SELECT a id, min(b) component_id FROM reach GROUP BY 1)"

_OP8 = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || '|'] ELSE [] END s FROM texts),
nodes AS (SELECT doc_id id, len(s) n FROM sets),
items AS (SELECT doc_id id, unnest(s) x FROM sets),
met AS (SELECT p.id a, q.id b, count(*) k FROM items p JOIN items q ON p.x = q.x AND p.id <> q.id GROUP BY 1, 2),
edges AS (SELECT a, b FROM met JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
{_COMPONENTS}
SELECT nodes.id doc_id, n n_shingles, component_id FROM nodes JOIN comp USING (id)
"""

_OP9 = f"""
WITH RECURSIVE nodes AS (SELECT vec_id id, embedding::DOUBLE[] v FROM embeddings),
good AS (SELECT id, v, sqrt(list_dot_product(v, v)) size FROM nodes WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
edges AS (SELECT p.id a, q.id b FROM good p JOIN good q ON p.id <> q.id AND len(p.v) = len(q.v) WHERE list_dot_product(p.v, q.v) / (p.size * q.size) >= 0.9::DOUBLE),
{_COMPONENTS}
SELECT id vec_id, coalesce(k, 0) n_links, component_id, component_id = id kept FROM comp LEFT JOIN (SELECT a id, count(*) k FROM edges GROUP BY 1) USING (id)
"""


def _op5() -> str:
    from lattica.llm.licenses import TEMPLATES, template_bigrams

    bags = sorted((lic, template_bigrams(t)) for lic, texts in TEMPLATES.items() for t in texts)
    longest = 2 * max(len(bag) for _, bag in bags)  # words: beyond any segment that a template fits
    rows = ", ".join(f"({k}, '{lic}', [{', '.join(chr(39) + b + chr(39) for b in bag)}])" for k, (lic, bag) in enumerate(bags))
    return f"""
WITH bags(k, license, bag) AS (VALUES {rows}),
texts AS (SELECT doc_id, coalesce(text, '') t FROM documents),
segs AS (SELECT DISTINCT doc_id, unnest(list_concat(list_concat(string_split(t, chr(10)), CASE WHEN regexp_matches(t, '\\n[\\x20\\x09-\\x0D]*\\n') THEN regexp_split_to_array(t, '\\n[\\x20\\x09-\\x0D]*\\n') ELSE [] END), [t])) seg FROM texts),
cut AS (SELECT doc_id, seg, regexp_extract_all(lower(seg), '[\\p{{L}}\\p{{N}}]+') w FROM segs),
fit AS (SELECT doc_id, seg, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] p FROM cut WHERE len(w) BETWEEN 2 AND {longest}),
mine AS (SELECT doc_id, seg, list_transform(p, lambda x, i: x || ' ' || len(list_filter(p[:i - 1], lambda y: y = x))) bag FROM fit),
scored AS (SELECT doc_id, seg, max({{'dice': 2e0 * len(list_intersect(mine.bag, bags.bag)) / (len(mine.bag) + len(bags.bag)), 'k': -k, 'license': license}}) best FROM mine, bags WHERE len(mine.bag) BETWEEN 0.6 * len(bags.bag) AND 1.6 * len(bags.bag) GROUP BY 1, 2),
hits AS (SELECT doc_id, best FROM scored WHERE best.dice >= 0.8),
per AS (SELECT doc_id, max(best) top, list_sort(list_distinct(list(best.license))) licenses, count(*) n FROM hits GROUP BY 1)
SELECT doc_id, top.license license, round(coalesce(top.dice, 0), 9) dice, array_to_string(coalesce(licenses, []), ',') licenses, coalesce(n, 0) n_segments FROM texts LEFT JOIN per USING (doc_id)
"""


def _op11(k: int = 8, rounds: int = 10) -> str:
    """Every vector meets every centroid in each round, a table expression a round."""
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        "flat AS MATERIALIZED (SELECT vec_id, unnest(range(64)) p, unnest(v) x FROM kept)",
        f"seeds AS (SELECT v, row_number() OVER (ORDER BY h) - 1 k FROM (SELECT v, sha256('3:' || vec_id) h FROM kept) ORDER BY h LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT k, unnest(range(64)) p, unnest(v) c FROM seeds)",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, min({{'d': d, 'k': k}}) best FROM (SELECT vec_id, k, CAST(sum((x - c) * (x - c)) AS BIGINT) d FROM flat JOIN c{r} USING (p) GROUP BY 1, 2) GROUP BY 1)")
        if r < rounds:
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts.append(f"m{r} AS (SELECT best.k k, p, CAST(sum(x) AS BIGINT) s, count(*) n FROM flat JOIN a{r} USING (vec_id) GROUP BY 1, 2)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, c{r}.p, CASE WHEN n > 0 THEN {mean} ELSE c END c FROM c{r} LEFT JOIN m{r} ON m{r}.k = c{r}.k AND m{r}.p = c{r}.p)")
    return f"""
WITH {", ".join(parts)},
shas AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY p)) centroid_sha256 FROM c{rounds} GROUP BY 1),
per AS (SELECT best.k k, CAST(sum(best.d) AS BIGINT) cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT vec_id, CAST(best.k AS INT) AS cluster, best.d distance, cluster_inertia, (SELECT CAST(sum(best.d) AS BIGINT) FROM a{rounds}) inertia, centroid_sha256
FROM a{rounds} JOIN per ON per.k = best.k JOIN shas ON shas.k = best.k
"""


_OP12 = """
WITH docs AS (SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
terms AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) n FROM terms GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) v, sum(n) n FROM kept GROUP BY 1),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) n FROM terms JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sums AS (SELECT lang, source, sum(n) n FROM counts GROUP BY 1, 2),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) AS BIGINT) p, CAST(1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS BIGINT) q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' part, b.source item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source s1, y.source s2, sum(abs(x.p - y.p)) f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) m ON m.lang = a.lang AND s1 = a.source AND s2 = b.source),
term AS (SELECT lang, source, 'term' part, term item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express: op8 and op9 by comparing all pairs, op5 by all templates of a segment's size, op11 with all centroids, op12 with all shares."""
    return {"op5_license_scan": _op5(), "op8_jaccard_join": _OP8, "op9_embedding_duplicates": _OP9, "op11_ball_kmeans": _op11(), "op12_source_divergence": _OP12}
