"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base figures are counted per document. Each rule rejects documents whose ratio lies above a cutoff. Cutoffs are not set by
hand: on the labelled holdout (all rows of ``labels``; nothing is fitted to them but the cutoffs) every stratum, here the
language, counts for each rule and candidate cutoff how many good documents (quality 1) the rule would reject. A cutoff is
certified where the exact binomial bound allows it: P(Bin(n, RISK / rules) <= k) <= DELTA / (rules * strata), which is the
Clopper-Pearson test that the false rejection rate is at most RISK / rules, corrected for the number of rules and strata.
Candidates of a rule are nested, from loose to strict, so that testing them in this order needs no further correction. The
strictest certified cutoff holds; a rule without one rejects nothing there. By the union bound a good document of a stratum
is falsely rejected by the rules with probability at most RISK, for all strata at once, with confidence 1 - DELTA.

Defined cases: a null or empty text has no words, so it fails the base; a null stratum is a stratum of its own; documents of
a stratum without labels only meet the base; a document with several labels counts
once for each; texts of any length are counted whole; a ratio equal to a cutoff passes; repeated rows stay, and count each;
empty tables give an empty result; columns beside doc_id, text and the stratum, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

#: Greatest share of good documents of a stratum that all rules together may reject, and the chance that this is missed.
RISK, DELTA = 0.02, 0.05
#: Candidate cutoffs by rule, from loose to strict.
CANDIDATES = {
    "symbols": [0.5, 0.3, 0.2, 0.1, 0.05, 0.02],
    "exclamation": [0.5, 0.3, 0.2, 0.1, 0.05, 0.02],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4],
    "repetition": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5],
}
#: What the ratios of the rules are made of.
RATIOS = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "exclamation": "n_exclamation / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repetition": "(n_words - n_distinct) / greatest(n_words, 1)",
}
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def figures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the base figures and what the ratios need, for each row of docs, over whole texts.

    Steps are separate projections: each array is bound to a column, so that no lambda computes it again.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select(
        "doc_id",
        F.col(f"`{stratum}`").alias("stratum"),
        F.filter(F.split(text, common.SEPARATORS), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_exclamation"),
    )
    # 3-word windows by hash, sorted with their place: equal ones become neighbours
    window = F.expr("transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i))")
    sorted_ = words.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 4, F.array_sort(window)).alias("sorted"),
    ).drop("w", "lines")
    twice = sorted_.select(
        *[c for c in sorted_.columns if c != "sorted"],
        F.expr("sort_array(transform(filter(sorted, (x, j) -> x.h = get(sorted, j - 1).h OR x.h = get(sorted, j + 1).h), x -> x.i))").alias("at"),
    )
    # each repeated window covers 3 words, less what the next one covers too
    covered = F.expr("aggregate(transform(at, (x, j) -> least(3, coalesce(get(at, j + 1) - x, 3))), 0, (s, x) -> s + x)")
    return twice.select(*[c for c in twice.columns if c != "at"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly in logarithms from the first term on."""
    import math

    first = n * F.lit(math.log1p(-p))
    odds = F.lit(math.log(p / (1 - p)))

    def add(s: Column, i: Column) -> Column:
        return F.struct((s["lp"] + F.log((n - i) / (i + F.lit(1.0))) + odds).alias("lp"), (s["sum"] + F.exp(s["lp"])).alias("sum"))

    state = F.struct(first.alias("lp"), F.lit(0.0).alias("sum"))
    steps = F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: i.cast("double"))
    # the step of i adds the term of i and forms the next one, which n > k allows
    return F.aggregate(steps, state, add, lambda s: s["sum"])


def cutoffs(measured: DataFrame, labels: DataFrame, work: common.Scratch, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per labelled stratum with a column cut_<rule>, null without a certified cutoff."""
    ratios = measured.select("doc_id", "stratum", *[F.expr(e).alias(r) for r, e in RATIOS.items()])
    good = labels.select(F.col("doc_id"), F.col("quality")).where("quality = 1").join(ratios, "doc_id")
    sums = [F.count_if(F.col(r) > c).alias(f"k_{r}_{j}") for r, cs in CANDIDATES.items() for j, c in enumerate(cs)]
    counted = work.write(good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums), "quality-counts")
    p, level = risk / len(CANDIDATES), delta / (len(CANDIDATES) * max(counted.count(), 1))
    out = []
    for r, cs in CANDIDATES.items():
        best = F.lit(None).cast("double")
        for j, c in enumerate(cs):
            k = F.col(f"k_{r}_{j}")
            # a count above its expectation can't pass, and isn't summed
            passed = F.when(k > F.col("n") * p, F.lit(False)).otherwise(binomial_cdf(F.col("n"), k, p) <= level)
            best = F.when(passed, F.lit(c)).otherwise(best)
        out.append(best.alias(f"cut_{r}"))
    return work.write(counted.select("stratum", *out), "quality-cutoffs")


def screen(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Per row of docs: its figures, base_failed, kept, and the rules that rejected it.

    Figures are computed once, into a table of a few numbers a document. The cutoffs, a row per stratum, are joined as a
    table whose size Spark knows: broadcast where it is small, else a shuffled join of the narrow rows.
    """
    work = common.Scratch(docs.sparkSession)
    measured = work.write(figures(docs, stratum), "quality-figures")
    cut = cutoffs(measured, labels, work)
    joined = measured.join(cut.withColumnRenamed("stratum", "cut_stratum"), F.expr("stratum <=> cut_stratum"), "left")
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    failed = F.filter(F.array(*[F.when(F.expr(e) > F.col(f"cut_{r}"), F.lit(r)) for r, e in RATIOS.items()]), lambda x: x.isNotNull())
    found = joined.select("doc_id", *FIGURES, base.alias("base_failed"), failed.alias("rejected_by"))
    return work.result(found.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("rejected_by")


def _oracle() -> str:
    """The same in DuckDB: base figures by unnesting, the binomial sum by lgamma."""
    import math

    p = RISK / len(CANDIDATES)
    cdf = f"list_sum(list_transform(range(0, {{k}} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * {math.log(p)!r} + (n - i) * {math.log1p(-p)!r})))"
    sums = ", ".join(f"count(*) FILTER ({RATIOS[r]} > {c}) AS k_{r}_{j}" for r, cs in CANDIDATES.items() for j, c in enumerate(cs))
    ok = lambda r, j: f"(k_{r}_{j} <= n * {p!r} AND {cdf.format(k=f'k_{r}_{j}')} <= {DELTA!r} / ({len(CANDIDATES)} * s))"
    cut = ", ".join("CASE " + " ".join(f"WHEN {ok(r, j)} THEN {c}" for j, c in reversed(list(enumerate(cs)))) + f" END AS cut_{r}" for r, cs in CANDIDATES.items())
    rejected = " OR ".join(f"coalesce({e} > cut_{r}, false)" for r, e in RATIOS.items())
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM h, (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamation,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(list_distinct(w))::BIGINT AS n_distinct,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
c AS (SELECT lang, count(*) AS n, {sums} FROM f JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang),
z AS (SELECT lang, {cut} FROM c, (SELECT count(*) AS s FROM c)),
b AS (SELECT f.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rejected} AS rejected FROM f LEFT JOIN z ON f.lang IS NOT DISTINCT FROM z.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM b"""


ORACLE = _oracle()
