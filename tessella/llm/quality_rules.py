"""Quality rules: fixed counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed words and word pairs are counted: one from the
trusted target (labelled good, not toxic), one from the whole raw corpus. A
document's score is the mean log ratio of its n-grams; it is kept when the mean
reaches a fixed threshold. There is no sampling and no randomness: equal texts
always get equal verdicts.

Plan: counting explodes only integer bucket ids, so map-side aggregation leaves
at most ``2 * buckets`` rows per task. The weights are one array of ``buckets``
floats (a scalar subquery of fixed size), so scoring is a projection over the
scan without any shuffle.

Edge cases: null text counts as empty; an empty text has no words, fails the
base rule and scores 0. A very long text is read whole, and its n-grams weigh like
any others. A score equal to the threshold is kept. Extra columns are carried through; one that is named like
a result of ``judge`` is replaced there, and kept by ``keep``. A repeated row is
scored like any other row. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, word_array

#: Hash buckets of the two multinomials; a fixed size, whatever the corpus is.
BUCKETS = 1 << 16
#: A document is kept when its mean log ratio is at least this.
THRESHOLD = -0.05
#: Added to each bucket's count, as a share of a mean bucket.
SMOOTHING = 0.5

#: Columns that ``judge`` adds.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_T = "__tessella_"


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets).cast("long")).cast("int")


def with_hashes(df: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """Add the words, their 64-bit hashes and the bucket ids of words and pairs."""
    h, w = f"{_T}h", f"{_T}words"
    out = df.withColumn(w, word_array(F.col(text)))
    out = out.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    pairs = F.when(
        F.size(h) >= 2,
        F.transform(
            F.sequence(F.lit(0), F.size(h) - 2),
            lambda i: _bucket(F.xxhash64(F.get(F.col(h), i), F.get(F.col(h), i + 1)), buckets),
        ),
    ).otherwise(F.array().cast("array<int>"))
    return out.withColumn(f"{_T}grams", F.concat(F.transform(h, lambda x: _bucket(x, buckets)), pairs))


def gram_weights(docs: DataFrame, target_ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with ``w``: the log ratio of target to raw, for each bucket in order.

    ``target_ids`` has the ids of trusted documents in a column ``doc_id``.
    Counts cover every document. Without any target or raw n-gram every weight
    is 0, so that nothing is rejected for lack of a model.
    """
    marked = target_ids.select(F.col("doc_id").alias(f"{_T}id")).where(F.col(f"{_T}id").isNotNull()).distinct().withColumn(f"{_T}t", F.lit(1))
    rows = docs.select(F.col(doc_id).alias(f"{_T}d"), F.col(text).alias(f"{_T}x"))
    # a merge join at every size: how much is moved must not depend on how many labels there are
    rows = rows.join(marked.hint("merge"), F.col(f"{_T}d") == F.col(f"{_T}id"), "left")
    # explode_outer: explode() makes Catalyst infer a size filter that copies the hashing into itself
    rows = with_hashes(rows, f"{_T}x", buckets).select(F.coalesce(f"{_T}t", F.lit(0)).alias("t"), F.explode_outer(f"{_T}grams").alias("b"))
    counts = rows.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    row = every.join(counts, "b", "left").agg(
        F.sort_array(F.collect_list(F.struct("b", F.coalesce("raw", F.lit(0)).cast("double").alias("raw"), F.coalesce("target", F.lit(0)).cast("double").alias("target")))).alias("e"),
        F.coalesce(F.sum("raw"), F.lit(0)).cast("double").alias("n_raw"),
        F.coalesce(F.sum("target"), F.lit(0)).cast("double").alias("n_target"),
    )

    def smooth(count: Column, total: Column) -> Column:
        return (count + smoothing * total / buckets) / total

    return row.select(
        F.when(
            (F.col("n_raw") > 0) & (F.col("n_target") > 0),
            F.transform("e", lambda x: F.log(smooth(x["target"], F.col("n_target")) / smooth(x["raw"], F.col("n_raw"))).cast("float")),
        )
        .otherwise(F.transform("e", lambda x: F.lit(0.0).cast("float")))  # not a literal of that many elements in every plan
        .alias("w")
    )


def with_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    h, tri = f"{_T}h", f"{_T}tri"
    x = F.coalesce(F.col(text), F.lit(""))
    out = df if h in df.columns else with_hashes(df, text)
    out = out.withColumn(
        tri,
        F.when(
            F.size(h) >= 4,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - 3),
                lambda i: F.xxhash64(F.get(F.col(h), i), F.get(F.col(h), i + 1), F.get(F.col(h), i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    s, starts = f"{_T}s", f"{_T}starts"
    out = out.withColumn(
        s,
        F.when(
            F.size(F.array_distinct(tri)) < F.size(tri),
            F.sort_array(F.transform(tri, lambda v, i: F.struct(v.alias("v"), i.alias("i")))),
        ),
    )
    out = out.withColumn(
        starts,
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform(s, lambda e, i: F.struct(e["i"].alias("i"), ((e["v"] == F.get(F.col(s), i + 1)["v"]) | (e["v"] == F.get(F.col(s), i - 1)["v"])).alias("twice"))),
                    lambda e: F.coalesce(e["twice"], F.lit(False)),
                ),
                lambda e: e["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col(starts), i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    lines = F.filter(F.split(x, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(f"{_T}lines", lines)
    out = out.withColumns(
        {
            "n_words": F.size(h).cast("long"),
            "word_chars": F.length(F.regexp_replace(x, SPACE, "")).cast("long"),
            "n_symbols": (F.length(x) - F.length(F.regexp_replace(x, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size(f"{_T}lines") - F.size(F.array_distinct(f"{_T}lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def judge(docs: DataFrame, target_ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the counts, ``llr`` (mean log ratio), ``base_failed`` and ``kept``."""
    weights = gram_weights(docs, target_ids, doc_id=doc_id, text=text, buckets=buckets)
    g, verdict = f"{_T}grams", f"{_T}verdict"
    out = with_rules(with_hashes(docs, text, buckets), text)
    out = out.withColumn(f"{_T}w", weights.scalar())
    total = F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(F.col(f"{_T}w"), b))
    out = out.withColumn("llr", F.when(F.size(g) > 0, total / F.size(g)).otherwise(F.lit(0.0)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    # all results become one generated value: a filter on one of them stays above it, where
    # Catalyst would else copy the hashing into the filter, once per use and per word
    own = [c for c in docs.columns if c not in RESULTS]
    out = out.select(*[F.col(f"`{c}`") for c in own], F.explode_outer(F.array(F.struct(*RESULTS))).alias(verdict))
    return out.select(*[F.col(f"`{c}`") for c in own], f"{verdict}.*")


def keep(docs: DataFrame, target_ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    judged = judge(rows, target_ids, **options)
    return judged.where("kept").select("row.*")
