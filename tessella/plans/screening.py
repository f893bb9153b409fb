"""Screening and sampling of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import screen
from tessella.plans.registry import query, spread, table

W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
GRAMS = "list_transform(range(1, len({0}) - 11), lambda i: array_to_string({0}[i:i+12], ' '))"


@query(rf"""
WITH b AS (SELECT DISTINCT unnest({GRAMS.format('w')}) AS gram FROM (SELECT {W.format('text')} AS w FROM benchmark)),
d AS (SELECT doc_id, {W.format('text')} AS w FROM documents),
g AS (SELECT doc_id, unnest({GRAMS.format('w')}) AS gram FROM d),
o AS (SELECT doc_id, count(*) AS n_grams, count(b.gram) AS hits FROM g LEFT JOIN b USING (gram) GROUP BY doc_id),
x AS (SELECT DISTINCT array_to_string({W.format('text')}, ' ') AS t FROM benchmark)
SELECT d.doc_id, coalesce(n_grams, 0)::BIGINT AS n_grams, coalesce(hits, 0)::BIGINT AS hits, round(coalesce(hits / n_grams, 0), 9) AS fraction,
  CASE WHEN x.t IS NOT NULL THEN 'exact' WHEN coalesce(hits, 0) > 0 THEN 'benchmark_overlap' ELSE 'kept' END AS reason
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN x ON array_to_string(w, ' ') = x.t""")
def screen_reasons(spark, sf_dir):
    """Word 13-gram decontamination: overlap counts and the first reason to drop each document."""
    docs, bench = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark")
    found = screen.overlap(docs, "doc_id", "text", bench, "text")
    exact = bench.select(T.normalize("text").alias("same")).distinct()
    joined = docs.select("doc_id", T.normalize("text").alias("norm")).join(found, "doc_id", "left").join(screen.bounded(exact), F.col("norm") == F.col("same"), "left")
    reason = screen.first_reason([("exact", F.col("same").isNotNull()), ("benchmark_overlap", F.col("hits") > 0)])
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_grams", "hits")], F.round(F.coalesce("fraction", F.lit(0.0)), 9).alias("fraction"), reason.alias("reason"))


@query(rf"""
WITH g AS (SELECT DISTINCT unnest({GRAMS.format('w')}) AS gram FROM (SELECT {W.format('text')} AS w FROM documents)),
i AS (SELECT item_id, unnest({GRAMS.format('w')}) AS gram FROM (SELECT item_id, {W.format('text')} AS w FROM benchmark)),
f AS (SELECT item_id, count(*) AS n_grams, count(g.gram) AS hits FROM i LEFT JOIN g USING (gram) GROUP BY item_id)
SELECT item_id, n_grams, hits, round(hits / n_grams, 9) AS fraction, hits > 0 AS any_hit, hits > 0.3 * n_grams AS over_30, hits > 0.5 * n_grams AS over_50 FROM f""")
def contamination_fractions(spark, sf_dir):
    """Share of each benchmark item's 13-grams that the corpus holds, each place counted; the corpus side is cut down to the
    items' grams before anything is shuffled."""
    items = screen.grams(table(spark, sf_dir, "benchmark"), "item_id", "text", 13)
    wanted = screen.bounded(items.select("gram").distinct())
    seen = screen.grams(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", 13).select("gram").join(wanted, "gram", "left_semi").distinct()
    f = items.join(seen.withColumn("hit", F.lit(1)), "gram", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_grams"), F.count("hit").alias("hits"))
    n, h = F.col("n_grams"), F.col("hits")
    return f.select("item_id", n, h, F.round(h / n, 9).alias("fraction"), (h > 0).alias("any_hit"), (h > 0.3 * n).alias("over_30"), (h > 0.5 * n).alias("over_50"))


@query(rf"""
WITH d AS (SELECT doc_id, array_to_string({W.format('text')}, ' ') AS norm, len({W.format('text')}) BETWEEN 24 AND 384 AS ok FROM documents),
s AS (SELECT *, ok AND doc_id = min(doc_id) FILTER (ok) OVER (PARTITION BY norm) AS first FROM d)
SELECT doc_id, CASE WHEN NOT ok THEN 'length' WHEN NOT first THEN 'duplicate' ELSE 'kept' END AS reason FROM s""")
def dedupe_first_seen(spark, sf_dir):
    """Normalised texts, first seen stays; a text that the length bounds reject was never seen."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.words("text").alias("w"))
    docs = docs.select("doc_id", F.sha2(F.array_join("w", " "), 256).alias("norm"), F.size("w").between(24, 384).alias("ok"))
    seen = screen.first_seen(docs, "norm", "doc_id", F.col("ok"))
    return seen.select("doc_id", screen.first_reason([("length", ~F.col("ok")), ("duplicate", ~F.col("_first"))]).alias("reason"))


@query(rf"""
WITH c AS (SELECT conv_id, turn, role, text, min(turn) OVER (PARTITION BY conv_id) AS low, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
f AS (SELECT conv_id, role, text, n, len({W.format('text')}) AS w FROM c WHERE turn = low)
SELECT CASE WHEN role <> 'user' THEN 'first_turn' WHEN contains(text, '<|') OR contains(text, '<think>') THEN 'special' WHEN n < 2 THEN 'no_reply' WHEN w < 8 THEN 'short' WHEN w > 60 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n
FROM f GROUP BY ALL""")
def conversation_cascade(spark, sf_dir):
    """First turns under an ordered cascade of reasons, each conversation counted once."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("t"), F.count(F.lit(1)).alias("n"))
    rules = [
        ("first_turn", F.col("t.role") != "user"),
        ("special", F.col("t.text").contains("<|") | F.col("t.text").contains("<think>")),
        ("no_reply", F.col("n") < 2),
        ("short", F.size(T.words("t.text")) < 8),
        ("long", F.size(T.words("t.text")) > 60),
    ]
    return first.select(screen.first_reason(rules).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH b AS (SELECT doc_id, lang, CASE WHEN n_chars < 1000 THEN '0-1k' WHEN n_chars < 4000 THEN '1k-4k' ELSE '4k+' END AS bin FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, bin ORDER BY sha256('s1:' || doc_id)) AS rank FROM b)
SELECT doc_id, lang, bin, rank FROM r WHERE rank <= 5""")
def stratified_sample(spark, sf_dir):
    """Five documents of each language and length bin, in hash order."""
    bins = F.when(F.col("n_chars") < 1000, "0-1k").when(F.col("n_chars") < 4000, "1k-4k").otherwise("4k+")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", bins.alias("bin"))
    return screen.hash_ordered(docs, ["lang", "bin"], "doc_id", "s1", 5).withColumn("rank", F.col("rank").cast("long"))


@query("""
SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY sha256('gold:' || doc_id)) - 1) % 4)::INTEGER AS gold FROM documents""")
def balanced_assignment(spark, sf_dir):
    """A cyclic label of four for the documents of each language, in hash order."""
    from tessella.operators.packing import offsets

    digest = F.sha2(F.concat(F.lit("gold:"), F.col("doc_id").cast("string")), 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("one"), digest.alias("digest"))
    placed = offsets(docs.withColumn("key", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")), "key", "one", ("lang",), ("digest",))
    return placed.select("doc_id", "lang", F.pmod("start", F.lit(4)).cast("int").alias("gold"))


@query("""SELECT bin, count(*) AS n FROM (SELECT CASE WHEN w < 100 THEN '0-100' WHEN w < 400 THEN '100-400' ELSE '400+' END AS bin FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS w FROM documents)) GROUP BY bin""")
def length_histogram(spark, sf_dir):
    w = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    bins = F.when(w < 100, "0-100").when(w < 400, "100-400").otherwise("400+")
    return table(spark, sf_dir, "documents").groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH o AS (SELECT lang, left(split_part(trim(text, ' '), chr(10), 1), 12) AS opening, min(doc_id) AS seen, count(*) AS n FROM documents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, seen) AS rank FROM o)
SELECT lang, opening, n, rank FROM r WHERE rank <= 3""")
def top_openings(spark, sf_dir):
    """The three most frequent openings of each language, ties by first seen."""
    from pyspark.sql import Window

    found = table(spark, sf_dir, "documents").groupBy("lang", T.opening("text", 12).alias("opening")).agg(F.min("doc_id").alias("seen"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "seen")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").drop("seen")


@query(r"""
WITH t AS (SELECT 'd' || doc_id AS k, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark),
w AS (SELECT k, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) AS w FROM t),
p AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
f AS (SELECT k, term, count(*) AS tf FROM p GROUP BY 1, 2),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY 1),
x AS (SELECT k, term, (1 + ln(tf)) * idf AS w FROM f JOIN i USING (term)),
n AS (SELECT k, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1),
y AS (SELECT k, term, w / norm AS w FROM x JOIN n USING (k)),
c AS (SELECT a.k, b.k AS ref, sum(a.w * b.w) AS dot FROM y a JOIN y b USING (term) WHERE a.k LIKE 'd%' AND b.k LIKE 'b%' GROUP BY 1, 2),
m AS (SELECT k, max(dot) AS cosine FROM c GROUP BY 1)
SELECT DISTINCT y.k AS key, round(coalesce(cosine, 0), 6) AS cosine FROM y LEFT JOIN m USING (k) WHERE y.k LIKE 'd%'""")
def tfidf_screen(spark, sf_dir):
    """Greatest TF-IDF cosine of every document with a benchmark item, by bounds; common terms form no pairs."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("key"), "text")
    found = screen.greatest_cosine(docs.unionAll(items), "key", "text", F.col("key").startswith("b"))
    return found.select("key", F.round("cosine", 6).alias("cosine"))


@query(r"""
WITH t AS (SELECT c.conv_id, c.turn, list_filter(string_split_regex(regexp_replace(regexp_replace(translate(lower(c.text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)', '\1 \3', 'g'), '(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)', '\1 \3', 'g'), '\s+'), lambda x: x <> '') AS w FROM conversations c WHERE role IN ('user', 'assistant')),
a AS (SELECT conv_id, turn, unnest(w) AS x FROM t), k AS (SELECT conv_id, turn, x, count(*) AS c FROM a GROUP BY ALL),
s AS (SELECT conv_id, turn, len(w) AS n FROM t),
o AS (SELECT p.conv_id, p.turn, sum(least(p.c, q.c)) AS same FROM k p JOIN k q ON p.conv_id = q.conv_id AND q.turn = p.turn + 1 AND p.x = q.x GROUP BY ALL)
SELECT s.conv_id, s.turn, round(coalesce(2.0 * same / nullif(s.n + r.n, 0), 0), 9) AS f1 FROM s JOIN s r ON r.conv_id = s.conv_id AND r.turn = s.turn + 1 LEFT JOIN o ON o.conv_id = s.conv_id AND o.turn = s.turn""")
def token_f1(spark, sf_dir):
    """Multiset word overlap of each turn with the next one: 2 * shared / (sum of lengths)."""
    turns = spread(table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").select("conv_id", "turn", "text")).select("conv_id", "turn", T.answer_words("text").alias("w"))
    counts = turns.select("conv_id", "turn", F.explode("w").alias("x")).groupBy("conv_id", "turn", "x").agg(F.count(F.lit(1)).alias("c"))
    after = counts.select("conv_id", (F.col("turn") - 1).alias("turn"), "x", F.col("c").alias("c2"))
    same = counts.join(after, ["conv_id", "turn", "x"]).groupBy("conv_id", "turn").agg(F.sum(F.least("c", "c2")).alias("same"))
    size = turns.select("conv_id", "turn", F.size("w").alias("n"))
    pairs = size.join(size.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("n2")), ["conv_id", "turn"])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("same"), F.col("n") + F.col("n2")), F.lit(0.0))
    return pairs.join(same, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(f1, 9).alias("f1"))


@query(r"""
WITH t AS (SELECT c.conv_id, c.turn, role, list_filter(string_split_regex(regexp_replace(regexp_replace(translate(lower(c.text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)', '\1 \3', 'g'), '(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)', '\1 \3', 'g'), '\s+'), lambda x: x <> '') AS w FROM conversations c),
a AS (SELECT conv_id, turn, role, unnest(w) AS x FROM t), k AS (SELECT conv_id, turn, role, x, count(*) AS c FROM a GROUP BY ALL),
o AS (SELECT p.conv_id, p.turn, q.turn AS gold, sum(least(p.c, q.c)) AS same FROM k p JOIN k q ON p.conv_id = q.conv_id AND p.role = 'assistant' AND q.role = 'user' AND p.x = q.x GROUP BY ALL),
f AS (SELECT o.conv_id, o.turn, o.gold, 2.0 * same / (len(x.w) + len(y.w)) AS f1 FROM o JOIN t x ON x.conv_id = o.conv_id AND x.turn = o.turn AND x.role = 'assistant' JOIN t y ON y.conv_id = o.conv_id AND y.turn = gold AND y.role = 'user')
SELECT t.conv_id, t.turn, round(coalesce(max(f1), 0), 9) AS f1, arg_max(gold, (f1, -gold)) AS gold FROM t LEFT JOIN f USING (conv_id, turn) WHERE role = 'assistant' GROUP BY 1, 2""")
def best_gold_f1(spark, sf_dir):
    """Of each reply the greatest multiset overlap with any of several golds, the user's turns of its conversation, and which."""
    turns = spread(table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", T.answer_words("text").alias("w"))
    counts = turns.select("conv_id", "turn", "role", F.size("w").alias("n"), F.explode("w").alias("x")).groupBy("conv_id", "turn", "role", "n", "x").agg(F.count(F.lit(1)).alias("c"))
    gold = counts.where("role = 'user'").select("conv_id", "x", F.col("turn").alias("gold"), F.col("n").alias("m"), F.col("c").alias("d"))
    same = counts.where("role = 'assistant'").join(gold, ["conv_id", "x"]).groupBy("conv_id", "turn", "n", "gold", "m").agg(F.sum(F.least("c", "d")).alias("same"))
    best = same.groupBy("conv_id", "turn").agg(F.max(F.struct((2.0 * F.col("same") / (F.col("n") + F.col("m"))).alias("f1"), (-F.col("gold")).alias("g"))).alias("b"))
    return turns.where("role = 'assistant'").select("conv_id", "turn").join(best, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(F.coalesce("b.f1", F.lit(0.0)), 9).alias("f1"), (-F.col("b.g")).alias("gold"))


@query(r"""
WITH n AS (SELECT doc_id, regexp_extract_all(text, '-?\d[\d,]*(?:\.\d+)?') AS m FROM documents)
SELECT doc_id, replace(m[-1], ',', '') AS last_number, CASE WHEN len(m) = 1 THEN replace(m[1], ',', '') END AS only_number FROM n""")
def extract_numbers(spark, sf_dir):
    """The last number of a text, and the number where there is exactly one."""
    one = F.translate(T.only_match("text", r"-?\d[\d,]*(?:\.\d+)?"), ",", "")
    last = F.translate(F.try_element_at(F.regexp_extract_all("text", F.lit(r"-?\d[\d,]*(?:\.\d+)?"), F.lit(0)), F.lit(-1)), ",", "")
    return table(spark, sf_dir, "documents").select("doc_id", last.alias("last_number"), one.alias("only_number"))


@query("""
WITH u AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1), q AS (SELECT c.conv_id, text FROM conversations c JOIN u USING (conv_id, turn)),
d AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant')
SELECT conv_id, length(text)::INTEGER AS n FROM q WHERE conv_id NOT IN (SELECT conv_id FROM d)""")
def pending_prompts(spark, sf_dir):
    """First user turns of conversations that have no reply yet: what a resumed run still has to do."""
    from tessella.operators.ledger import pending

    turns = table(spark, sf_dir, "conversations")
    prompts = turns.where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("t")).select("conv_id", F.length("t.text").alias("n"))
    return pending(prompts, turns.where("role = 'assistant'"), "conv_id")
