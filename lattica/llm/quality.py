"""Quality rules by weak supervision, in DataFrame operations only.

Rules vote good (1), bad (-1) or abstain (0) on each document. How often each rule votes bad on good and on bad
documents, and how many documents are good, is estimated by expectation-maximisation over the counts of vote
patterns (at most 3 ** rules rows, however many documents there are). A document's posterior probability of being good
decides, in place of a demand that all rules pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stage, words

WINDOW = 5

#: No rule may be taken to vote bad on more than this share of good documents.
MOST_ON_GOOD = 0.02

#: Features, in the order in which they are made.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_bangs", "n_distinct", "n_lines", "n_marks", "n_wordless", "n_stutter"]


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns BASE and MORE (long); null texts count as empty, empty texts have zeros everywhere."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_t": text, "_w": words(F.col(text_col)), "_l": lines})
    out = out.withColumns({"_c": F.array_join("_w", ""), "_h": F.transform("_w", lambda w: F.xxhash64(w))})
    n = F.size("_w")
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)]))
    )
    out = out.withColumn("_h", windows)
    # sorting is for the texts that do repeat a window
    out = out.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    out = out.withColumn("_h", F.when(F.col("_again"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    repeated = F.filter(
        F.transform(
            F.col("_h"),
            lambda x, k: F.when(x["h"].eqNullSafe(F.get(F.col("_h"), k - 1)["h"]) | x["h"].eqNullSafe(F.get(F.col("_h"), k + 1)["h"]), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(F.sort_array(repeated), first, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    new = {
        "n_words": n,
        "word_chars": F.char_length("_c"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_upper": F.regexp_count("_c", F.lit(r"\p{Lu}")),
        "n_bangs": F.regexp_count("_c", F.lit(r"[!?]")),
        "n_distinct": F.size(F.array_distinct("_w")),
        "n_lines": F.size("_l"),
        "n_marks": F.regexp_count("_c", F.lit(r"[^\p{L}\p{N}]")),
        "n_wordless": F.regexp_count("_t", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")),
        "n_stutter": F.size(F.filter("_w", lambda w, i: w == F.get("_w", i - 1))),
    }
    kept = [c for c in docs.columns if c.lower() not in new]
    return out.select(*[docs[c] for c in kept], *[c.cast("long").alias(k) for k, c in new.items()])


def rules() -> dict[str, Column]:
    """Name -> vote. Thresholds are shares of words, of their characters, or of lines."""
    n, chars, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    def high(share: Column, bad: float, good: float) -> Column:
        return vote(share > bad, share < good)

    distinct, length = F.col("n_distinct") / n, chars / n
    return {
        "repeats": high(F.col("n_repeat_words") / n, 0.2, 0.08),
        "symbols": high(F.col("n_symbols") / n, 0.1, 0.03),
        "marks": high(F.col("n_marks") / chars, 0.2, 0.12),
        "wordless": high(F.col("n_wordless") / n, 0.2, 0.1),
        "stutter": high(F.col("n_stutter") / n, 0.2, 0.05),
        "capitals": high(F.col("n_upper") / chars, 0.3, 0.15),
        "bangs": high(F.col("n_bangs") / n, 0.2, 0.05),
        "variety": vote((F.col("n_words") >= 20) & (distinct < 0.15), (F.col("n_words") < 200) & (distinct > 0.4)),
        "word_length": vote((length < 2.5) | (length > 14), length.between(3.5, 10)),
        "lines": high(F.col("n_dup_lines") / lines, 0.3, 0.1),
        "length": vote(F.col("n_words") < 5, F.col("n_words") >= 30),
    }


def fit_votes(votes: DataFrame, names: list[str], rounds: int = 25, prior: float = 0.85) -> dict:
    """EM over vote patterns. Returns the share of good documents and, by rule, P(bad vote | it votes) for either class.

    Rates start from "a bad vote is ten times likelier on a bad document" and stay on that side of 1, which also fixes
    which class is called good; counts are smoothed by a few pseudo-documents, so rules that never vote are harmless
    and an empty table gives the starting values. Null votes count as abstentions.
    """
    patterns = stage(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).orderBy(*names), files=1)
    share, bad_rate = prior, {k: (0.02, 0.3) for k in names}  # (on good, on bad) documents
    for _ in range(rounds):
        rated = patterns.withColumn("_p", _posterior(share, bad_rate))  # a column, so that the plan has it once, not in each of the sums
        p = F.col("_p")
        sums = [F.sum(F.col("_n") * p).alias("_good"), F.sum("_n").alias("_all")]
        for k in names:
            for vote, of in ((-1, "b"), (1, "g")):
                hit = F.when(F.col(k) == vote, F.col("_n")).otherwise(0)
                sums += [F.sum(hit * p).alias(f"{of}1{k}"), F.sum(hit * (1 - p)).alias(f"{of}0{k}")]
        got = rated.agg(*sums).first()
        if not got["_all"]:
            break
        before = share
        share = min(max((got["_good"] + 8.5) / (got["_all"] + 10), 0.05), 0.995)
        for k in names:
            on_good = (got[f"b1{k}"] + 0.2) / (got[f"b1{k}"] + got[f"g1{k}"] + 10)
            on_bad = (got[f"b0{k}"] + 3) / (got[f"b0{k}"] + got[f"g0{k}"] + 10)
            on_good = min(max(on_good, 1e-4), MOST_ON_GOOD)
            bad_rate[k] = (on_good, min(max(on_bad, 2 * on_good), 0.999))
        if abs(share - before) < 1e-7:
            break
    return {"share": share, "bad_rate": bad_rate}


def _posterior(share: float, bad_rate: dict) -> Column:
    score = F.lit(math.log(share / (1 - share)))
    for k, (g, b) in bad_rate.items():
        score = score + F.when(F.col(k) == -1, math.log(g / b)).when(F.col(k) == 1, math.log((1 - g) / (1 - b))).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def judge_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with features, base_failed, quality (posterior, double) and kept.

    base_failed: fewer than 10 words, or over 20 % of words in repeated windows; such rows are never kept. Null and
    empty texts have no words and so fail. Every row comes back, repeated rows too; input columns that are called like an
    output column are replaced. Votes of rows that base_failed decides are not used for the rates. The texts are read once: their features are staged.

    The estimates are held within bounds, so that a table without bad documents doesn't turn a rule against good ones: a rule votes bad on
    MOST_ON_GOOD of good documents at most and on at least twice that share of bad ones; the share of good documents is 0.05 to 0.995.
    """
    names = list(rules())
    featured = with_features(docs, text_col)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    cols = [c for c in featured.columns if keep is None or c in keep or c in BASE + MORE]
    voted = stage(featured.select(*cols, base.alias("base_failed"), *[v.cast("int").alias(f"_vote_{k}") for k, v in rules().items()]))
    model = fit_votes(voted.where(~F.col("base_failed")), [f"_vote_{k}" for k in names])
    p = _posterior(model["share"], model["bad_rate"])
    return voted.withColumn("quality", p).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*[f"_vote_{k}" for k in names])
