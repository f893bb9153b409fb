"""Intervals, effects, decision trees, audits of tensors and codes, custody of results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import stats
from tessella.operators import blocks, decide, joins
from tessella.plans import screening
from tessella.operators.packing import offsets
from tessella.plans.registry import ORACLE_SQL, query, table

R = lambda c, n=6: F.round(c, n)
#: Student's quantile in SQL: bisection of the same integral, by Simpson's rule.
T_SQL = """WITH RECURSIVE df AS (SELECT DISTINCT n - 1 AS df, exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) * 2 / sqrt(pi()) AS c FROM g),
t AS (SELECT df, c, 0.0::DOUBLE AS low, least(pi() / 2, 40 / sqrt(df)) AS high, 0 AS i FROM df UNION ALL
  SELECT df, c, CASE WHEN area < 0.95 THEN mid ELSE low END, CASE WHEN area < 0.95 THEN high ELSE mid END, i + 1 FROM (SELECT *, (low + high) / 2 AS mid, c * (low + high) / 2 / 1200 * list_sum(list_transform(range(0, 401), lambda k: CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos((low + high) / 2 * k / 400), df - 1))) AS area FROM t WHERE i < 46))
SELECT df, sqrt(df) * tan((low + high) / 2) AS c FROM t WHERE i = 46"""


@query(f"""WITH d AS (SELECT l_suppkey, l_extendedprice / l_quantity - 1500 AS d FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT l_suppkey, count(*) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se FROM d GROUP BY 1 HAVING count(*) >= 2), q AS ({T_SQL})
SELECT l_suppkey, n, round(m, 5) AS mean, round(m - c * se, 5) AS low, round(m + c * se, 5) AS high FROM g JOIN q ON df = n - 1""")
def student_intervals(spark, sf_dir):
    """Mean differences by group with Student's interval; groups of any size have their own critical value."""
    d = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity") - 1500).alias("d"))
    g = d.groupBy("l_suppkey").agg(F.count("d").alias("n"), F.avg("d").alias("m"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se")).where("n >= 2")
    found = g.select("*", (stats.t_quantile(F.col("n") - 1) * F.col("se")).alias("half"))
    return found.select("l_suppkey", "n", R(F.col("m"), 5).alias("mean"), R(F.col("m") - F.col("half"), 5).alias("low"), R(F.col("m") + F.col("half"), 5).alias("high"))


@query("""WITH m AS (SELECT c_nationkey, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS a, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS b, avg(c_acctbal) FILTER (c_mktsegment = 'FURNITURE') AS c, avg(c_acctbal) FILTER (c_mktsegment = 'HOUSEHOLD') AS d FROM customer GROUP BY 1)
SELECT c_nationkey, round(((b - a) + (d - c)) / 2, 6) AS first, round(((c - a) + (d - b)) / 2, 6) AS second, round((d - c) - (b - a), 6) AS interaction FROM m""")
def factorial_effects(spark, sf_dir):
    """Main effects and interaction of a design of two by two arms, by group."""
    arms = ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD"]
    m = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", arms).agg(F.avg("c_acctbal"))
    a, b, c, d = (F.col(x) for x in arms)
    return m.select("c_nationkey", R(((b - a) + (d - c)) / 2).alias("first"), R(((c - a) + (d - b)) / 2).alias("second"), R((d - c) - (b - a)).alias("interaction"))


def _wilson_sql(k: str, n: str) -> str:
    mid, half, den = f"({k} / {n} + 1.9208 / {n})", f"1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 0.9604 / ({n} * {n}))", f"(1 + 3.8416 / {n})"
    return f"round(100 * ({mid} - {half}) / {den}, 6) AS {k}_low, round(100 * ({mid} + {half}) / {den}, 6) AS {k}_high"


@query(f"""WITH h AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS raw, count(*) FILTER (o_orderstatus IN ('F', 'P'))::DOUBLE AS calibrated FROM orders GROUP BY 1)
SELECT o_orderpriority, {_wilson_sql("raw", "n")}, {_wilson_sql("calibrated", "n")} FROM h""")
def binding_metrics(spark, sf_dir):
    """Two accuracies of each group, with Wilson's interval in percent for both."""
    h = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("raw"), F.count_if(F.col("o_orderstatus").isin("F", "P")).cast("double").alias("calibrated"))
    out, n = [], F.col("n")
    for name in ("raw", "calibrated"):
        p = F.col(name) / n
        mid, half, den = p + 1.9208 / n, 1.96 * F.sqrt(p * (1 - p) / n + 0.9604 / (n * n)), 1 + 3.8416 / n
        out += [R(100 * (mid - half) / den).alias(f"{name}_low"), R(100 * (mid + half) / den).alias(f"{name}_high")]
    return h.select("o_orderpriority", *out)


@query("""WITH p AS (SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS gold, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT gold, count(*) AS hits FROM p GROUP BY 1)
SELECT gold AS position, hits, round(hits / (SELECT count(*) FROM p), 9) AS share, round((SELECT avg(1.0 / n) FROM p), 9) AS chance FROM c ORDER BY hits DESC, gold LIMIT 1""")
def best_position(spark, sf_dir):
    """The fixed place that is right most often, against chance."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("k")))["k"].alias("k"), F.count(F.lit(1)).alias("n"))
    every = p.agg(F.count(F.lit(1)).alias("all"), F.avg(1.0 / F.col("n")).alias("chance"))
    c = p.groupBy((-F.col("k")).alias("position")).agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "position").limit(1)
    return c.crossJoin(F.broadcast(every)).select("position", "hits", R(F.col("hits") / F.col("all"), 9).alias("share"), R("chance", 9).alias("chance"))


@query(f"""WITH b AS ({ORACLE_SQL["contamination_fractions"]}), f AS (SELECT item_id, fraction FROM b)
SELECT count(*) AS n, count(*) FILTER (fraction > 0) AS some, count(*) FILTER (fraction > 0.3) AS over_30, count(*) FILTER (fraction > 0.5) AS over_50, round(max(fraction), 6) AS most, round(avg(fraction), 6) AS mean, (SELECT string_agg(item_id, ' ' ORDER BY fraction DESC, item_id DESC) FROM (SELECT * FROM f ORDER BY fraction DESC, item_id DESC LIMIT 3)) AS top FROM f""")
def contamination_summary(spark, sf_dir):
    """How many texts share word grams at all, over 30 and over 50 %; the greatest and mean share; and the three worst."""
    f = screening.contamination_fractions(spark, sf_dir).select("item_id", "fraction")
    top = f.orderBy(F.desc("fraction"), F.desc("item_id")).limit(3).agg(F.sort_array(F.collect_list(F.struct("fraction", "item_id")), False)["item_id"].alias("t"))
    v = F.col("fraction")
    found = f.agg(F.count(F.lit(1)).alias("n"), F.count_if(v > 0).alias("some"), F.count_if(v > 0.3).alias("over_30"), F.count_if(v > 0.5).alias("over_50"), R(F.max(v)).alias("most"), R(F.avg(v)).alias("mean"))
    return found.crossJoin(F.broadcast(top)).select("*", F.array_join(F.transform("t", lambda x: x.cast("string")), " ").alias("top")).drop("t")


#: Names of tensors outside blocks with their region, and the first part of names inside by region (a public format's names).
OUTSIDE = {"token_embd.weight": "embedding", "output.weight": "lm_head", "output_norm.weight": "normalization"}
INSIDE = {"ffn_": "mlp", "ssm_": "recurrent_state"}
#: Bytes of storage types by number: of an element, or of a group of elements.
STORED = {0: (1, 4), 30: (1, 2), 142: (128, 34)}


def region(name):
    """The region of a tensor by its name; the first rule that fits decides."""
    inner = F.regexp_extract(name, r"^blk\.\d+\.(.*)$", 1)
    out = F.lit(None)
    for n, r in OUTSIDE.items():
        out = F.coalesce(out, F.when(name == n, r))
    for start, r in INSIDE.items():
        out = F.coalesce(out, F.when(F.startswith(inner, F.lit(start)), r))
    return F.coalesce(out, F.when(~F.startswith(name, F.lit("blk.")), "other"), F.when(F.contains(inner, F.lit("norm")), "normalization"), F.lit("attention_projection"))


def stored_bytes(kind, elements):
    """Bytes of a tensor; an unknown type, or elements that fill no whole groups, are an error."""
    out = F.raise_error(F.concat(F.lit("storage type "), kind.cast("string"))).cast("long")
    for k, (group, size) in STORED.items():
        whole = F.when(elements % group == 0, F.floor(elements / group) * size).otherwise(F.raise_error(F.lit("no whole groups")).cast("long"))
        out = F.when(kind == k, whole).otherwise(out)
    return out


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'token_embd.weight' WHEN 1 THEN 'blk.' || p_partkey || '.ffn_up.weight' WHEN 2 THEN 'blk.' || p_partkey || '.ssm_a' WHEN 3 THEN 'blk.' || p_partkey || '.attn_q_norm.weight' WHEN 4 THEN 'blk.' || p_partkey || '.attn_k.weight' WHEN 5 THEN 'output.weight' ELSE 'rope' END AS name, p_size * 128 AS elements FROM part)
SELECT CASE p_partkey % 7 WHEN 0 THEN 'embedding' WHEN 1 THEN 'mlp' WHEN 2 THEN 'recurrent_state' WHEN 3 THEN 'normalization' WHEN 4 THEN 'attention_projection' WHEN 5 THEN 'lm_head' ELSE 'other' END AS region, CASE WHEN p_partkey % 7 IN (1, 2, 3, 4) THEN CASE WHEN p_partkey % 4 = 3 THEN 'full_attention' ELSE 'linear_attention' END END AS kind, count(*) AS tensors, sum(elements)::BIGINT AS elements, sum(CASE p_partkey % 3 WHEN 0 THEN elements * 4 WHEN 1 THEN elements * 2 ELSE elements // 128 * 34 END)::BIGINT AS bytes FROM t GROUP BY ALL""")
def tensor_regions(spark, sf_dir):
    """Tensors, elements and bytes by region and kind of block, from names and storage types."""
    k = F.col("p_partkey").cast("string")
    names = F.array(F.lit("token_embd.weight"), F.concat(F.lit("blk."), k, F.lit(".ffn_up.weight")), F.concat(F.lit("blk."), k, F.lit(".ssm_a")), F.concat(F.lit("blk."), k, F.lit(".attn_q_norm.weight")), F.concat(F.lit("blk."), k, F.lit(".attn_k.weight")), F.lit("output.weight"), F.lit("rope"))
    t = table(spark, sf_dir, "part").select(F.get(names, (F.col("p_partkey") % 7).cast("int")).alias("name"), (F.col("p_size") * 128).alias("elements"), F.get(F.array(F.lit(0), F.lit(30), F.lit(142)), (F.col("p_partkey") % 3).cast("int")).alias("type"))
    block = F.regexp_extract("name", r"^blk\.(\d+)\.", 1)
    kind = F.when(block != "", F.when(block.try_cast("long") % 4 == 3, "full_attention").otherwise("linear_attention"))
    return t.groupBy(region(F.col("name")).alias("region"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("tensors"), F.sum("elements").alias("elements"), F.sum(stored_bytes(F.col("type"), F.col("elements"))).alias("bytes"))


@query("""WITH a AS (SELECT 'layers.' || s_suppkey || '.w' AS packed, s_nationkey AS v FROM supplier), b AS (SELECT 'model.' || s_suppkey || '.weight' AS source, s_nationkey % 3 AS shard FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT packed, source, shard, CASE WHEN source IS NULL THEN 'no source' WHEN packed IS NULL THEN 'no packed' ELSE 'both' END AS state FROM a FULL JOIN b ON regexp_extract(packed, '[0-9]+') = regexp_extract(source, '[0-9]+')""")
def mapped_names(spark, sf_dir):
    """Packed tensors, source tensors and their shards joined by a mapping of names; what lacks on either side shows."""
    s = table(spark, sf_dir, "supplier")
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).alias("number")
    a = s.select(F.concat(F.lit("layers."), F.col("s_suppkey").cast("string"), F.lit(".w")).alias("packed"))
    b = s.where("s_suppkey % 5 <> 0").select(F.concat(F.lit("model."), F.col("s_suppkey").cast("string"), F.lit(".weight")).alias("source"), (F.col("s_nationkey") % 3).alias("shard"))
    both = a.select("packed", number("packed")).join(b.select("source", "shard", number("source")), "number", "full_outer")
    return both.select("packed", "source", "shard", F.when(F.col("source").isNull(), "no source").when(F.col("packed").isNull(), "no packed").otherwise("both").alias("state"))


@query("""WITH a AS (SELECT p_partkey AS name, p_type AS storage, p_size AS elements, p_retailprice AS offset FROM part), b AS (SELECT p_partkey AS name, CASE WHEN p_size = 7 THEN 'F16' ELSE p_type END AS storage, p_size AS elements, p_retailprice + (p_size % 2) / 8 AS offset FROM part WHERE p_brand <> 'Brand#11')
SELECT name, (a.name IS NULL OR b.name IS NULL OR a.storage <> b.storage OR a.elements <> b.elements) AS differs, round(abs(a.offset - b.offset), 6) AS delta FROM a FULL JOIN b USING (name)""")
def tolerant_inventory(spark, sf_dir):
    """Two inventories that must be equal but for one column, and by how much that one differs."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_type").alias("storage"), F.col("p_size").alias("elements"), F.col("p_retailprice").alias("offset"))
    b = table(spark, sf_dir, "part").where("p_brand <> 'Brand#11'").select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") == 7, "F16").otherwise(F.col("p_type")).alias("storage"), F.col("p_size").alias("elements"), (F.col("p_retailprice") + (F.col("p_size") % 2) / 8).alias("offset"))
    return joins.annotated_differences(a, b, ["name"], "offset").withColumn("delta", R("delta"))


RULE = {"reference_binding": 40.0, "reference_pairwise": 30.0, "knowledge_low": 45.0, "informative_low": 48.0, "rise": 0.5, "broken": 47.0, "intact": 52.0}


def diagnosed(m, binding: str = "calibrated"):
    """The rules of the diagnosis, as data: branches in their order, the arms of each, and when one more is asked for."""
    at = lambda name: F.lit(RULE[name])
    invalid = (m[f"reference_{binding}"] < at("reference_binding")) | (m["reference_pairwise"] < at("reference_pairwise"))
    intact, open_book = m["binding"] >= at("intact"), F.greatest(m["reference_cloze_chat_low"], m["reference_cloze_raw_low"]) > at("informative_low")
    known = F.greatest(m["cloze_chat_low"], m["cloze_raw_low"]) > at("knowledge_low")
    rules = [("harness_invalid", invalid), ("readout_broken", m["binding"] < at("broken")), ("knowledge_lost", intact & open_book & ~known), ("closed_book_readout", intact & open_book)]
    rises = [(m[f"{k}_rise"] >= at("rise")) & (m[f"{k}_rise_low"] > 0) for k in ("letter", "cloze")]
    usual = ["M", "U"]
    arms = {"knowledge_lost": ["U", "B"], "readout_broken": usual, "closed_book_readout": usual, "ambiguous": usual}
    return decide.branches(rules, "ambiguous", arms, [(rises[0] | rises[1], "B")], {"harness_invalid"})


@query("""WITH v AS (SELECT c_nationkey, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') / 100 AS b, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') / 100 AS m, avg(c_acctbal) FILTER (c_mktsegment = 'FURNITURE') / 100 AS f, avg(c_acctbal) FILTER (c_mktsegment = 'HOUSEHOLD') / 100 AS h FROM customer GROUP BY 1),
r AS (SELECT *, (m - f >= 0.5 AND h > 0) OR (h - b >= 0.5 AND f > 45) AS rising, greatest(f, h) > 45 AS knows, greatest(h, b) > 48 AS informative FROM v),
k AS (SELECT *, CASE WHEN f < 40 OR h < 30 THEN 'harness_invalid' WHEN b < 47 THEN 'readout_broken' WHEN b >= 52 AND NOT informative THEN 'ambiguous' WHEN b >= 52 AND NOT knows THEN 'knowledge_lost' WHEN b >= 52 THEN 'closed_book_readout' ELSE 'ambiguous' END AS branch,
 CASE WHEN m < 40 OR h < 30 THEN 'harness_invalid' WHEN b < 47 THEN 'readout_broken' WHEN b >= 52 AND NOT informative THEN 'ambiguous' WHEN b >= 52 AND NOT knows THEN 'knowledge_lost' WHEN b >= 52 THEN 'closed_book_readout' ELSE 'ambiguous' END AS amended FROM r)
SELECT c_nationkey, branch, CASE WHEN branch = 'harness_invalid' THEN '' WHEN branch = 'knowledge_lost' THEN 'U,B' WHEN rising THEN 'M,U,B' ELSE 'M,U' END AS arms, amended FROM k""")
def diagnostic_branches(spark, sf_dir):
    """The branch of each row of metrics, the arms it asks for, and the branch under the amended floor."""
    names = {"b": "BUILDING", "m": "MACHINERY", "f": "FURNITURE", "h": "HOUSEHOLD"}
    v = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", list(names.values())).agg(F.avg("c_acctbal") / 100)
    b, m, f, h = (F.col(x) for x in names.values())
    metrics = {"reference_calibrated": f, "reference_raw": m, "reference_pairwise": h, "binding": b, "cloze_chat_low": f, "cloze_raw_low": h, "reference_cloze_chat_low": h, "reference_cloze_raw_low": b, "letter_rise": m - f, "letter_rise_low": h, "cloze_rise": h - b, "cloze_rise_low": f - 45}
    rows = v.select("c_nationkey", F.struct(*[c.alias(n) for n, c in metrics.items()]).alias("m"))
    found = rows.select("c_nationkey", diagnosed(F.col("m")).alias("d"), diagnosed(F.col("m"), "raw").alias("a"))
    return found.select("c_nationkey", "d.branch", F.array_join("d.arms", ",").alias("arms"), F.col("a.branch").alias("amended"))


@query("""WITH a AS (SELECT o_custkey AS g, o_orderpriority AS arm, avg(o_totalprice) / 1000 AS s, max(o_totalprice) / 1000 AS hi, min(o_totalprice) / 1000 AS lo, count(*) AS n FROM orders GROUP BY ALL),
f AS (SELECT *, lo > 100 AND s > 150 AS effect, lo > 130 AS gain, hi < 350 AS affordable, CASE WHEN arm IN ('1-URGENT', '2-HIGH') THEN lo > 100 AND s > 150 AND n > 1 END AS fast_helps, CASE WHEN arm IN ('4-NOT SPECIFIED', '5-LOW') THEN (lo > 100 AND s > 150) OR lo > 130 END AS slow_helps FROM a),
w AS (SELECT g, list(arm ORDER BY -round(s, 3), arm) FILTER (effect AND affordable AND n > 1) AS w, count(*) AS arms, count(*) FILTER (fast_helps) AS fast, count(*) FILTER (slow_helps) AS slow, bool_or(effect) AS effect, bool_or(gain AND affordable) AS gain, bool_or(arm = '3-MEDIUM' AND affordable) AS medium FROM f GROUP BY g)
SELECT g, CASE WHEN arms < 2 THEN 'too few arms' WHEN w IS NOT NULL THEN 'adopt' WHEN fast > 0 AND slow = 0 THEN 'fast only' WHEN slow > 0 AND fast = 0 THEN 'slow only' WHEN effect OR gain THEN 'repeat' WHEN medium THEN 'hold' ELSE 'stop' END AS recommendation, coalesce(array_to_string(w, ','), '') AS winners, fast, slow FROM w""")
def factorial_decisions(spark, sf_dir):
    """What the arms of each group recommend by a ladder of rules, with the winners in order and how many arms bear each
    hypothesis out."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("arm")).agg((F.avg("o_totalprice") / 1000).alias("s"), (F.max("o_totalprice") / 1000).alias("hi"), (F.min("o_totalprice") / 1000).alias("lo"), F.count(F.lit(1)).alias("n"))
    f = a.select("*", F.expr("lo > 100 AND s > 150").alias("effect"), F.expr("lo > 130").alias("gain"), F.expr("hi < 350").alias("affordable"), F.round("s", 3).alias("score"))
    helps = {"fast_helps": (["1-URGENT", "2-HIGH"], F.col("effect") & (F.col("n") > 1)), "slow_helps": (["4-NOT SPECIFIED", "5-LOW"], F.col("effect") | F.col("gain"))}
    each = f.select("*", *decide.hypotheses(F.col("arm"), helps)).groupBy("g").agg(F.collect_list(F.struct("arm", "n", "effect", "gain", "affordable", "score", *helps)).alias("arms"))
    arms = F.col("arms")
    bearing = lambda h: F.size(F.filter(arms, lambda x: F.coalesce(x[h], F.lit(False)))).cast("long")
    counted = each.select("*", *[bearing(h).alias(h[:4]) for h in helps], decide.ranked(arms, lambda x: x["effect"] & x["affordable"] & (x["n"] > 1), "score").alias("winners"))
    rules = [
        ("too few arms", F.size(arms) < 2),
        ("adopt", F.size("winners") > 0),
        ("fast only", (F.col("fast") > 0) & (F.col("slow") == 0)),
        ("slow only", (F.col("slow") > 0) & (F.col("fast") == 0)),
        ("repeat", decide.holds_for(arms, lambda x: x["effect"]) | decide.holds_for(arms, lambda x: x["gain"] & x["affordable"])),
        ("hold", decide.holds_for(arms, lambda x: x["affordable"], "3-MEDIUM")),
    ]
    return counted.select("g", decide.ladder(rules, "stop").alias("recommendation"), F.array_join("winners", ",").alias("winners"), "fast", "slow")


@query("""WITH e AS (SELECT l_suppkey, avg(l_discount - 0.05) * 100 AS m, 196 * stddev_samp(l_discount) / sqrt(count(*)) AS h, avg(l_tax) AS t, avg(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING count(*) > 1),
d AS (SELECT l_suppkey, CASE WHEN m >= 0.05 AND m - h > 0 AND t > 0.035 AND q < 27 AND q > 20 THEN 'increase' WHEN m + h < 0 THEN 'keep_worse' ELSE 'keep_inconclusive' END AS dose, CASE WHEN abs(q - 25) > 0.2 THEN round((m - t) / (q - 25), 6) END AS closed FROM e)
SELECT * FROM d""")
def dose_decisions(spark, sf_dir):
    """Whether a dose goes up, and the share of a gap that is closed, by group."""
    d = F.col("l_discount")
    e = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.avg(d - 0.05) * 100).alias("m"), (196 * F.stddev_samp(d) / F.sqrt(F.count(d))).alias("h"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"), F.count(d).alias("n")).where("n > 1")
    m, h, t, q = (F.col(x) for x in "mhtq")
    dose = decide.dose(m, m - h, m + h, 0.05, t > 0.035, q < 27, q > 20)
    return e.select("l_suppkey", dose.alias("dose"), R(decide.gap_closed(m - t, F.lit(0.0), q - 25, 0.2)).alias("closed"))


@query("""WITH v AS (SELECT o_custkey AS g, o_orderpriority AS variant, avg(o_totalprice) / 1000 AS m, min(o_totalprice) / 1000 AS lo, count(*) AS n FROM orders GROUP BY ALL),
a AS (SELECT g, max(m) FILTER (variant = '1-URGENT') AS om, max(lo) FILTER (variant = '1-URGENT') AS olo, max(n) FILTER (variant = '1-URGENT') AS n FROM v GROUP BY g),
s AS (SELECT v.g, count(*) FILTER (variant <> '1-URGENT' AND v.n >= 2) AS sane, bool_and(NOT (variant <> '1-URGENT' AND v.n >= 2) OR (lo > 50 AND m >= 0.8 * om)) AS hold FROM v JOIN a USING (g) GROUP BY v.g)
SELECT g, CASE WHEN coalesce(n < 2, true) THEN 'harness_invalid' WHEN olo <= 50 OR sane < 2 THEN 'inconclusive' WHEN hold THEN 'robust' ELSE 'not_robust' END AS verdict FROM a JOIN s USING (g)""")
def robustness_verdicts(spark, sf_dir):
    """Whether a gain holds in all variants that pass the check of sanity."""
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("variant")).agg((F.avg("o_totalprice") / 1000).alias("mean"), (F.min("o_totalprice") / 1000).alias("low"), F.count(F.lit(1)).alias("n"))
    each = v.groupBy("g").agg(F.collect_list(F.struct("variant", (F.col("n") >= 2).alias("sane"), "mean", "low")).alias("v"))
    return each.select("g", decide.robustness(F.col("v"), "1-URGENT", 50.0, 0.8, 2).alias("verdict"))


@query("""WITH r AS (SELECT conv_id, turn, role, md5(concat_ws(':', 'draw', conv_id, turn)) AS h, row_number() OVER (PARTITION BY role ORDER BY md5(concat_ws(':', 'draw', conv_id, turn))) AS k, count(*) OVER (PARTITION BY role) AS n FROM conversations)
SELECT role, conv_id, turn, row_number() OVER (ORDER BY md5(concat_ws(':', 'order', conv_id, turn)), conv_id, turn) - 1 AS place FROM r WHERE k <= greatest(1, n // 10)""")
def shuffled_quota(spark, sf_dir):
    """A tenth of each stratum without replacement, by hash; and a place for each in one order over all, in two passes."""
    def hashed(df, word):
        digest = F.md5(F.concat_ws(":", F.lit(word), "conv_id", "turn"))
        return df.select("conv_id", "turn", "role", F.lit(1).alias("one"), digest.alias("h")).withColumn("key", F.conv(F.left("h", F.lit(15)), 16, 10).cast("long"))

    turns = hashed(table(spark, sf_dir, "conversations"), "draw")
    size = turns.groupBy(F.col("role").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    placed = offsets(turns, "key", "one", ("role",), ("h",))
    drawn = placed.join(size, F.col("role").eqNullSafe(F.col("of"))).where(F.expr("start < greatest(1, n div 10)"))
    order = offsets(hashed(drawn, "order"), "key", "one", ties=("h", "conv_id", "turn"))
    return order.select("role", "conv_id", "turn", F.col("start").alias("place"))


@query("""WITH t AS (SELECT l_partkey, l_suppkey, list(l_linenumber ORDER BY l_linenumber) AS ids, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, count(DISTINCT ids) = 1 AS same_tokens, count(*) AS arms, CASE WHEN count(DISTINCT ids) = 1 THEN round(avg(m), 4) END AS mean FROM t GROUP BY 1""")
def paired_tokens(spark, sf_dir):
    """Means over arms only where all arms were scored on the same tokens."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"), F.avg("l_extendedprice").alias("m"))
    same = F.size(F.collect_set("ids")) == 1
    return t.groupBy("l_partkey").agg(same.alias("same_tokens"), F.count(F.lit(1)).alias("arms"), F.when(same, R(F.avg("m"), 4)).alias("mean"))


@query("""WITH s AS (SELECT l_orderkey, list(l_tax) AS nll, count(DISTINCT l_linenumber) AS ids, any_value(o_orderkey) AS expected FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT l_orderkey, len(nll) AS n, CASE WHEN expected IS NULL THEN 'unknown id' WHEN ids <> len(nll) THEN 'repeated token' WHEN len(list_filter(nll, lambda x: x IS NULL OR x < 0)) > 0 THEN 'bad value' WHEN len(nll) > 7 THEN 'too long' ELSE 'valid' END AS state FROM s""")
def validated_scores(spark, sf_dir):
    """Score rows before they are published: known id, as many values as tokens, finite values, length."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_tax")).alias("nll"), F.countDistinct("l_linenumber").alias("ids"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("expected")).distinct()
    s = rows.join(known, F.expr("l_orderkey = expected"), "left")
    state = F.when(F.col("expected").isNull(), "unknown id").when(F.col("ids") != F.size("nll"), "repeated token").when(F.exists("nll", lambda x: x["l_tax"].isNull() | F.isnan(x["l_tax"]) | (x["l_tax"] < 0)), "bad value").when(F.size("nll") > 7, "too long").otherwise("valid")
    return s.select("l_orderkey", F.size("nll").cast("long").alias("n"), state.alias("state"))


@query("""WITH b AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'go' ELSE 'stop' END AS decision, sha256(s_name) AS protocol FROM supplier), a AS (SELECT s_suppkey, 'amended' AS decision, CASE WHEN s_suppkey % 2 = 0 THEN sha256(s_name) ELSE sha256('other') END AS bound FROM supplier WHERE s_nationkey < 10)
SELECT s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN b.decision WHEN bound = protocol THEN a.decision ELSE b.decision END AS decision, a.s_suppkey IS NOT NULL AND bound <> protocol AS refused FROM b LEFT JOIN a USING (s_suppkey)""")
def effective_decisions(spark, sf_dir):
    """Decisions with amendments, which count only where they name the digest of the protocol they amend."""
    s = table(spark, sf_dir, "supplier")
    b = s.select("s_suppkey", F.when(F.col("s_acctbal") > 0, "go").otherwise("stop").alias("base"), F.sha2("s_name", 256).alias("protocol"))
    a = s.where("s_nationkey < 10").select("s_suppkey", F.lit("amended").alias("amended"), F.sha2(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.lit("other")), 256).alias("bound"))
    bound = F.coalesce(F.col("bound") == F.col("protocol"), F.lit(False))
    return b.join(a, "s_suppkey", "left").select("s_suppkey", F.when(bound, F.col("amended")).otherwise(F.col("base")).alias("decision"), (F.col("bound").isNotNull() & ~bound).alias("refused"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, sha256(o_orderkey || ':' || o_custkey) AS raw FROM orders), s AS (SELECT c_custkey, sha256(c_name) AS selection FROM customer), m AS (SELECT o_custkey, min(o_orderdate) AS selected FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT r.o_orderkey, selection, raw, sha256(coalesce(selection, '') || raw) AS result, coalesce(o_orderdate > selected, false) AS in_order FROM r JOIN orders o ON o.o_orderkey = r.o_orderkey LEFT JOIN s ON s.c_custkey = r.o_custkey LEFT JOIN m ON m.o_custkey = r.o_custkey""")
def custody(spark, sf_dir):
    """Each result with the digests of what it came from, and whether its selection was made before it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", F.sha2(F.concat_ws(":", "o_orderkey", "o_custkey"), 256).alias("raw"))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.sha2("c_name", 256).alias("selection"))
    m = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("selected"))
    both = o.join(s, "o_custkey", "left").join(m, "o_custkey", "left")
    return both.select("o_orderkey", "selection", "raw", F.sha2(F.concat(F.coalesce("selection", F.lit("")), "raw"), 256).alias("result"), F.coalesce(F.col("o_orderdate") > F.col("selected"), F.lit(False)).alias("in_order"))


@query("""WITH s AS (SELECT c_custkey, c_acctbal, (c_custkey - 1) // 256 AS shard FROM customer), d AS (SELECT shard, count(*) AS n, count(*) FILTER (c_acctbal IS NOT NULL) AS valid FROM s GROUP BY 1)
SELECT shard, n, CASE WHEN n = valid AND (n = 256 OR shard = (SELECT max(shard) FROM d)) THEN 'done' ELSE 'again' END AS state FROM d""")
def resumed_shards(spark, sf_dir):
    """Shards of 256 rows, written one by one after validation, and what a run that goes on finds done."""
    from tessella.sources import files

    path = files.folder(spark)
    s = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.expr("(c_custkey - 1) div 256").alias("shard"))
    s.write.partitionBy("shard").parquet(f"{path}/shards")
    found = spark.read.parquet(f"{path}/shards").groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("valid"))
    last = found.agg(F.max("shard").alias("last"))
    whole = (F.col("n") == F.col("valid")) & ((F.col("n") == 256) | (F.col("shard") == F.col("last")))
    return found.join(F.broadcast(last)).select("shard", "n", F.when(whole, "done").otherwise("again").alias("state"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), a AS (SELECT vec_id, x, list_max(list_transform(x, lambda y: abs(y))) AS m FROM v)
SELECT vec_id, round(m, 6) AS scale, list_sum(list_transform(x, lambda y: CASE WHEN m = 0 THEN 0 ELSE sign(y) * floor(abs(y) / m + 0.5) END))::BIGINT AS code_sum, len(list_filter(x, lambda y: m > 0 AND floor(abs(y) / m + 0.5) > 0)) AS nonzero,
 round(greatest(coalesce(list_sum(list_transform(x, lambda y: CASE WHEN m = 0 THEN 0 ELSE sign(y) * floor(abs(y) / m + 0.5) END * y)) / nullif(len(list_filter(x, lambda y: m > 0 AND floor(abs(y) / m + 0.5) > 0)), 0), 0), 0), 6) AS least_squares FROM a""")
def absmax_codes(spark, sf_dir):
    """Ternary codes by the greatest magnitude of a group, halves rounded up, and the least-squares scale clipped at zero."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda y: y.cast("double")).alias("x"))
    a = v.withColumn("m", F.array_max(F.transform("x", lambda y: F.abs(y))))
    a = a.withColumn("c", F.transform("x", lambda y: F.when(F.col("m") == 0, 0.0).otherwise(F.signum(y) * F.floor(F.abs(y) / F.col("m") + 0.5))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, y: s + y)
    nonzero = F.size(F.filter("c", lambda y: y != 0))
    scale = F.greatest(F.coalesce(F.try_divide(total(F.zip_with("c", "x", lambda c, y: c * y)), nonzero), F.lit(0.0)), F.lit(0.0))
    return a.select("vec_id", R("m").alias("scale"), total("c").cast("long").alias("code_sum"), nonzero.cast("long").alias("nonzero"), R(scale).alias("least_squares"))


@query("""WITH b AS (SELECT c_custkey, [ascii(x) FOR x IN string_split(c_name, '')] AS b FROM customer)
SELECT c_custkey, 8 * len(b) AS n, list_sum([bit_count(x::UTINYINT::BIT::VARCHAR::BIT) FOR x IN b])::BIGINT AS ones, list_sum([2 * (x & 1) - 1 FOR x IN b])::BIGINT AS first_of_bytes FROM b""")
def one_bit_codes(spark, sf_dir):
    """Bytes as signs of one bit each, the lowest first: how many there are, how many are positive, and the sum of each byte's first."""
    from tessella.functions.codes import one_bit

    signs = table(spark, sf_dir, "customer").select("c_custkey", one_bit(F.encode("c_name", "utf-8")).alias("s"))
    each = F.sequence(F.lit(0), F.floor(F.size("s") / 8).cast("int") - 1)
    first = F.aggregate(F.transform(each, lambda i: F.get("s", i * 8)), F.lit(0).cast("long"), lambda a, x: a + x)
    return signs.select("c_custkey", F.size("s").cast("long").alias("n"), F.size(F.filter("s", lambda x: x > 0)).cast("long").alias("ones"), first.alias("first_of_bytes"))


@query("""SELECT doc_id, (length(text) + 7)::INTEGER AS n, md5(left(text, 5) || 'SPLICED' || substr(text, 6)) AS digest, left(text, 5) = left(left(text, 5) || 'SPLICED' || substr(text, 6), 5) AS head_kept FROM documents WHERE length(text) >= 10""")
def spliced(spark, sf_dir):
    """A piece put into a text behind its head, with the rest unchanged on both sides."""
    t, docs = F.col("text"), table(spark, sf_dir, "documents").where("length(text) >= 10")
    made = docs.withColumn("made", F.overlay(t, F.lit("SPLICED"), F.lit(6), F.lit(0)))
    kept = (F.left("made", F.lit(5)) == F.left(t, F.lit(5))) & (F.substring("made", F.lit(13), F.length("made")) == F.substring(t, F.lit(6), F.length(t)))
    return made.select("doc_id", F.length("made").alias("n"), F.md5(F.when(kept, F.col("made")).otherwise(F.raise_error(F.lit("bytes changed")))).alias("digest"), kept.alias("head_kept"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice AS scale, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(concat_ws(':', 'perturb', l_linenumber, l_suppkey, l_partkey)), l_suppkey, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, sum(CASE WHEN k > n // 2 * 2 THEN 0 WHEN k % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS sign_sum, round(sum(scale * CASE WHEN k > n // 2 * 2 THEN 1 WHEN k % 2 = 1 THEN 1.01 ELSE 0.99 END), 4) AS perturbed FROM g GROUP BY 1""")
def perturbed_scales(spark, sf_dir):
    """Scales of a group moved by one percent, as many up as down, in hash order; an odd one out stays."""
    h = F.md5(F.concat_ws(":", F.lit("perturb"), "l_linenumber", "l_suppkey", "l_partkey"))
    w = Window.partitionBy("l_orderkey")
    g = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w.orderBy(h, "l_suppkey", "l_partkey"))).withColumn("n", F.count(F.lit(1)).over(w))
    sign = F.when(F.expr("k > n div 2 * 2"), 0).when(F.col("k") % 2 == 1, 1).otherwise(-1)
    return g.groupBy("l_orderkey").agg(F.sum(sign).alias("sign_sum"), R(F.sum(F.col("l_extendedprice") * (1 + sign * 0.01)), 4).alias("perturbed"))


@query("""WITH e AS (SELECT event_id, props FROM events) SELECT event_id, string_agg(k || '=' || v, ',' ORDER BY k) AS leaves FROM (SELECT event_id, unnest(json_keys(props)) AS k, props FROM e), LATERAL (SELECT json_extract_string(props, '$."' || k || '"') AS v) GROUP BY 1""")
def json_leaves(spark, sf_dir):
    """Every leaf of JSON values of any depth, with its path."""
    from tessella.functions.codes import leaves

    found = table(spark, sf_dir, "events").select("event_id", F.explode(leaves("props")).alias("path", "value"))
    return found.groupBy("event_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "value"))), lambda x: F.concat_ws("=", x["path"], x["value"])), ",").alias("leaves"))


@query("""WITH v AS (SELECT vec_id // 128 AS block, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), d AS (SELECT block, x, list_transform(x, lambda y: round(y * 8) / 8 - y) AS d FROM v)
SELECT block, count(*) AS rows_, round(sum(list_dot_product(d, d)), 6) AS error, round(sum(list_dot_product(d, d)) / sum(list_dot_product(x, x)), 9) AS relative, round(max(list_max(list_transform(d, lambda y: abs(y)))), 6) AS most FROM d GROUP BY 1""")
def blocked_compare(spark, sf_dir):
    """Rows against their rounded form, in blocks of 128 rows: error, error relative to the rows' own trace, and the greatest."""
    v = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 128").alias("block"), F.transform("embedding", lambda y: y.cast("double")).alias("x"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group.x)
        q = np.sign(x) * np.floor(np.abs(x) * 8 + 0.5) / 8
        d = q - x
        return pd.DataFrame({"block": group.block[:1], "rows_": [len(x)], "error": [(d * d).sum()], "relative": [(d * d).sum() / (x * x).sum()], "most": [np.abs(d).max()]})

    found = v.groupBy("block").applyInPandas(compare, "block long, rows_ long, error double, relative double, most double")
    return found.select("block", "rows_", R("error").alias("error"), R("relative", 9).alias("relative"), R("most").alias("most"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS w, list_transform(embedding, lambda x: x::DOUBLE - round_even(x::DOUBLE * 8, 0) / 8) AS d FROM embeddings),
p AS (SELECT sum(pow(list_dot_product(x.w, y.d), 2)) AS e, sum(pow(list_dot_product(x.w, y.w), 2)) AS t FROM v x, v y)
SELECT round(e, 3) AS error, round(t, 3) AS total, round(e / t, 9) AS ratio FROM p""")
def weighted_error(spark, sf_dir):
    """What rounding to eighths costs the outputs: the error weighted by all vectors' second moments, against the whole, by
    products of blocks of 16. In SQL, as sums over all pairs."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    v = offsets(v.withColumn("one", F.lit(1)), "vec_id", "one").select(F.col("start").alias("n"), "w", F.transform("w", lambda x: x - F.rint(x * 8) / 8).alias("d"))
    w, d = blocks.blocked(v, "n", "w", 16), blocks.blocked(v, "n", "d", 16)
    h = blocks.gram(w, 16)
    error, total = (blocks.weighted_square(m, h, 16).withColumnRenamed("value", n) for m, n in ((d, "error"), (w, "total")))
    one = error.crossJoin(F.broadcast(total))  # aggregates without keys: a row each
    return one.select(R("error", 3).alias("error"), R("total", 3).alias("total"), R(F.col("error") / F.col("total"), 9).alias("ratio"))
