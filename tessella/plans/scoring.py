"""Score vectors, paired statistics and resampling. Embeddings stand for score vectors, order measures for paired scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import stats
from tessella.functions import vectors as V
from tessella.operators import accumulate, joins, resample
from tessella.operators.quantiles import quantiles
from tessella.plans.registry import query, table
from tessella.sources import files

R = lambda c, n=6: F.round(c, n)
ARMS = "SELECT l_partkey, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS a, avg(l_extendedprice) FILTER (l_returnflag = 'N') AS n, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1"


def arms(spark, sf_dir):
    """Mean price of each part in three arms, for parts that have all three."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("score"))
    return joins.complete_cases(items, "l_partkey", "l_returnflag", "score", ["A", "N", "R"])


@query(f"SELECT l_partkey, round(a, 7) AS \"A\", round(n, 7) AS \"N\", round(r, 7) AS \"R\" FROM ({ARMS}) WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL")
def complete_cases(spark, sf_dir):
    return arms(spark, sf_dir).select("l_partkey", *[R(c, 7).alias(c) for c in "ANR"])


@query(f"""WITH d AS (SELECT a - n AS d FROM ({ARMS}) WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL), s AS (SELECT avg(d) AS m, 1.96 * stddev_samp(d) / sqrt(count(*)) AS h, count(*) AS n, count(*) FILTER (d > 0) AS above FROM d)
SELECT n, round(m, 4) AS mean, round(m - h, 4) AS low, round(m + h, 4) AS high, above, CASE WHEN m - h > 0 AND above >= 0.9 * n THEN 'support' WHEN m + h < 0 THEN 'exclude' ELSE 'unresolved' END AS decision FROM s""")
def paired_interval(spark, sf_dir):
    """Paired difference of two arms with its normal interval, and what point, interval and signs decide."""
    from tessella.operators.decide import verdict

    d = arms(spark, sf_dir).select((F.col("A") - F.col("N")).alias("d"))
    mean, low, high = stats.mean_interval(F.col("d"))
    s = d.agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"), low.alias("low"), high.alias("high"), F.count_if(F.col("d") > 0).alias("above"))
    return s.select("n", R("mean", 4).alias("mean"), R("low", 4).alias("low"), R("high", 4).alias("high"), "above", verdict(F.col("low"), F.col("high"), F.col("above") >= 0.9 * F.col("n")).alias("decision"))


@query("""
WITH k AS (SELECT lang, count(*) AS n, sum(toxic) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, n, k::BIGINT AS k, round((k/n + 1.96*1.96/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 8) AS low, round((k/n + 1.96*1.96/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 8) AS high FROM k""")
def wilson_intervals(spark, sf_dir):
    k = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return k.select("lang", "n", "k", R(low, 8).alias("low"), R(high, 8).alias("high"))


@query("""SELECT c_mktsegment, round(avg(m), 4) AS mean_of_means, count(*) AS customers FROM (SELECT c_mktsegment, c_custkey, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1""")
def two_stage_mean(spark, sf_dir):
    """Means of customers' means, of those with two orders or more: not the mean of all orders."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return own.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(R(F.avg("m"), 4).alias("mean_of_means"), F.count(F.lit(1)).alias("customers"))


D = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"SELECT label, round(avg(list_avg(e[1:8])), 6) AS early, round(avg(list_avg(e[9:40])), 6) AS mid, round(avg(list_avg(e[41:64])), 6) AS late, round(avg(list_sum(e)), 6) AS total FROM (SELECT label, {D} AS e FROM embeddings) GROUP BY label")
def band_means(spark, sf_dir):
    """Means of position bands of vectors, by label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    bands = {"early": (0, 8), "mid": (8, 40), "late": (40, 64)}
    return e.groupBy("label").agg(*[R(F.avg(V.band_mean("e", *b))).alias(n) for n, b in bands.items()], R(F.avg(V.total("e"))).alias("total"))


@query(f"""WITH e AS (SELECT vec_id, {D} AS e FROM embeddings) SELECT a.vec_id, round(list_max(list_transform(range(1, 65), lambda i: abs(a.e[i] - b.e[i]))), 6) AS max_abs, round(list_avg(list_transform(range(1, 65), lambda i: a.e[i] - b.e[i])), 6) AS mean FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def vector_differences(spark, sf_dir):
    """Position by position, each vector against the next one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").withColumn("d", V.difference("a", "b"))
    return pairs.select("vec_id", R(V.max_abs("d")).alias("max_abs"), R(V.total("d") / F.size("d")).alias("mean"))


@query(f"""WITH s AS (SELECT vec_id, (label % 4)::INTEGER AS gold, ({D})[1:4] AS v FROM embeddings), o AS (SELECT *, v[gold + 1] AS g, list_filter([1, 2, 3, 4], lambda i: i <> gold + 1) AS rest FROM s)
SELECT vec_id, gold, (list_position(v, list_max(v)) - 1)::INTEGER AS pred, g > list_max(list_transform(rest, lambda i: v[i])) AS hit, round(list_sum(list_transform(rest, lambda i: CASE WHEN g > v[i] THEN 1.0 WHEN g = v[i] THEN 0.5 ELSE 0.0 END)) / 3, 6) AS pairwise,
round(g - (list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v)))))), 6) AS logp, round(list_sum(list_transform(v, lambda x: exp(x))), 6) AS mass FROM o""")
def choice_scores(spark, sf_dir):
    """Four options: first argmax, strict hit, pairwise score, renormalised log-probability and mass."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.pmod("label", F.lit(4)).alias("gold"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("v"))
    gold = F.col("gold")
    return s.select("vec_id", "gold", V.first_argmax("v").alias("pred"), V.strict_hit("v", gold).alias("hit"), R(V.pairwise("v", gold)).alias("pairwise"), R(F.get("v", gold) - V.log_sum_exp("v")).alias("logp"), R(V.total(F.transform("v", lambda x: F.exp(x)))).alias("mass"))


@query(f"""WITH s AS (SELECT vec_id, label, (label % 4)::INTEGER AS gold, ({D})[1:4] AS v FROM embeddings), p AS (SELECT vec_id, label, gold, unnest(range(0, 4)) AS pos, unnest(v) - (list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v)))))) AS lp FROM s),
m AS (SELECT label, pos, avg(lp) AS bias FROM p GROUP BY 1, 2), c AS (SELECT vec_id, label, gold, list(lp - bias ORDER BY pos) AS v FROM p JOIN m USING (label, pos) GROUP BY 1, 2, 3)
SELECT label, count(*) AS n, count(*) FILTER (list_position(v, list_max(v)) - 1 = gold) AS hits FROM c GROUP BY 1""")
def calibrated_choice(spark, sf_dir):
    """Accuracy by arm after an arm-wide mean for each letter is taken out of the renormalised scores."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.pmod("label", F.lit(4)).alias("gold"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("v"))
    each = s.withColumn("z", V.log_sum_exp("v")).select("vec_id", "label", "gold", F.posexplode(F.transform("v", lambda x: x - F.col("z"))).alias("pos", "lp"))
    bias = each.groupBy("label", "pos").agg(F.avg("lp").alias("bias"))
    back = each.join(bias, ["label", "pos"]).groupBy("vec_id", "label", "gold").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("lp") - F.col("bias")).alias("c")))).alias("t"))
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(V.first_argmax(F.col("t.c")) == F.col("gold")).alias("hits"))


@query()
def bootstrap_interval(spark, sf_dir):
    """Intervals of the mean balance of all customers from 10,000 resamples, by the three rules; every replicate draws as many
    rows as there are. Its draws come from keyed generators, which SQL has not: tests hold it against plain resampling."""
    v = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    means = resample.bootstrap_means(v, "c_custkey", "x", "b1", 10_000)
    drawn = means.agg(F.sum("n").alias("draws"), F.count(F.lit(1)).alias("replicates"))
    own = v.agg(F.avg("x").alias("mean"), F.count("x").alias("n"))
    one = F.broadcast(own.crossJoin(F.broadcast(drawn)))  # aggregates without keys: a row each
    return resample.interval_rules(means).crossJoin(one).select("rule", "n", "replicates", "draws", R("mean", 4).alias("mean"), R("low", 4).alias("low"), R("high", 4).alias("high"))


@query("""WITH c AS (SELECT n_regionkey AS ka, month(o_orderdate) - 1 AS kb, avg(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
sa AS (SELECT ka, row_number() OVER (ORDER BY ka) - 1 AS a FROM (SELECT DISTINCT ka FROM c)), sb AS (SELECT kb, row_number() OVER (ORDER BY kb) - 1 AS b FROM (SELECT DISTINCT kb FROM c)),
da AS (SELECT rep, (('0x' || substr(sha256('w' || 'a:' || rep || ':' || i), 1, 8))::BIGINT % (SELECT count(*) FROM sa)) AS a, count(*) AS na FROM range(0, 20000) r(rep), range(0, (SELECT count(*) FROM sa)) i(i) GROUP BY 1, 2),
db AS (SELECT rep, (('0x' || substr(sha256('w' || 'b:' || rep || ':' || i), 1, 8))::BIGINT % (SELECT count(*) FROM sb)) AS b, count(*) AS nb FROM range(0, 20000) r(rep), range(0, (SELECT count(*) FROM sb)) i(i) GROUP BY 1, 2),
m AS (SELECT rep, sum(x * na * nb) / sum(na * nb) AS m FROM da JOIN db USING (rep) JOIN sa USING (a) JOIN sb USING (b) JOIN c USING (ka, kb) GROUP BY rep)
SELECT round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM m""")
def cluster_bootstrap(spark, sf_dir):
    """Both sides of a table resampled apart, 20,000 times; the interval interpolates between means."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = o.groupBy(F.col("n_regionkey").cast("long").alias("a"), (F.month("o_orderdate") - 1).cast("long").alias("b")).agg(F.avg("o_totalprice").alias("x"))
    m = resample.two_way_means(cells, "a", "b", "x", "w", 20_000)
    p = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return m.agg(p.alias("p")).select(R(F.col("p")[0], 3).alias("low"), R(F.col("p")[1], 3).alias("high"))


@query("""WITH p AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS o, avg(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT count(*) AS n, round(avg((f - o) - (p - o)), 3) AS interaction, round((avg(f) - avg(o)) / nullif(avg(p) - avg(o), 0), 5) AS gap_closed, round(avg((f - o) / nullif(p - o, 0)), 2) AS mean_of_ratios FROM p WHERE f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL""")
def differences_of_differences(spark, sf_dir):
    """Interaction of arms, and the share of a gap closed: a ratio of means, beside the mean of ratios."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    w = joins.complete_cases(own, "o_custkey", "o_orderstatus", "m", ["F", "O", "P"])
    f, o, p = F.col("F"), F.col("O"), F.col("P")
    return w.agg(F.count(F.lit(1)).alias("n"), R(F.avg((f - o) - (p - o)), 3).alias("interaction"), R(F.try_divide(F.avg(f) - F.avg(o), F.avg(p) - F.avg(o)), 5).alias("gap_closed"), R(F.avg(F.try_divide(f - o, p - o)), 2).alias("mean_of_ratios"))


@query("""WITH w AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')), b AS (SELECT l_suppkey, l_partkey, count(*) AS k FROM w GROUP BY 1, 2)
SELECT l_suppkey, count(*) FILTER (k = 2) AS inter, count(*) AS uni, round(count(*) FILTER (k = 2) / count(*), 9) AS jaccard FROM b GROUP BY 1""")
def support_jaccard(spark, sf_dir):
    """Jaccard similarity of the parts that a supplier sold in two arms."""
    w = table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')").groupBy("l_suppkey", "l_partkey").agg(F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    inter = F.count_if((F.col("a") == 1) & (F.col("r") == 1))
    return w.groupBy("l_suppkey").agg(inter.alias("inter"), F.count(F.lit(1)).alias("uni"), R(inter / F.count(F.lit(1)), 9).alias("jaccard"))


@query("""WITH d AS (SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, avg(value / 100) AS nll FROM events GROUP BY 1) SELECT day, round(nll, 8) AS nll, round(exp(nll), 6) AS perplexity, round(nll - lag(nll) OVER (ORDER BY day), 8) AS drop FROM d""")
def training_curve(spark, sf_dir):
    """Mean loss by checkpoint, its perplexity, and the change from the one before; days are few."""
    d = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg(F.col("value") / 100).alias("nll"))
    change = F.col("nll") - F.lag("nll").over(Window.orderBy("day"))
    return d.select("day", R("nll", 8).alias("nll"), R(F.exp("nll")).alias("perplexity"), R(change, 8).alias("drop"))


@query("""WITH p AS (SELECT l_returnflag AS arm, l_linestatus AS pred, count(*) AS c FROM lineitem GROUP BY 1, 2), g AS (SELECT o_orderstatus AS gold, count(*) AS c FROM orders GROUP BY 1)
SELECT arm, round(sum(p.c * g.c * (pred = gold)::INTEGER) / (sum(p.c * g.c)), 9) AS chance FROM p, g GROUP BY arm""")
def chance_agreement(spark, sf_dir):
    """Accuracy that predictions would have if they were dealt out anew: a product of two tables of counts."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count(F.lit(1)).alias("k"))
    total = table(spark, sf_dir, "orders").count()
    hits = p.join(g, "value", "left").groupBy("arm").agg(F.sum(F.col("c") * F.coalesce("k", F.lit(0))).alias("h"), F.sum("c").alias("n"))
    return hits.select("arm", R(F.col("h") / (F.col("n") * F.lit(total)), 9).alias("chance"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity * 1000 AS y FROM lineitem)
SELECT count(*) FILTER (x = y) AS same, round(avg((x <> y)::INTEGER), 9) AS changed, round(max(abs(x - y)), 4) AS max_abs, round(quantile_cont(abs(x - y), 0.5), 4) AS p50, round(quantile_cont(abs(x - y), 0.95), 4) AS p95, round(quantile_cont(abs(x - y), 0.99), 4) AS p99, round(sqrt(sum((x - y) ^ 2) / sum(x * x)), 8) AS relative_l2, round(corr(x, y), 8) AS correlation FROM a""")
def difference_profile(spark, sf_dir):
    """Two aligned measures: how many equal, size of the differences by exact percentiles, relative norm, correlation."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 1000).alias("y")).withColumn("d", F.abs(F.col("x") - F.col("y")))
    p = quantiles(a, "d", [0.5, 0.95, 0.99], name="p")
    s = a.agg(F.count_if(F.col("x") == F.col("y")).alias("same"), F.avg((F.col("x") != F.col("y")).cast("int")).alias("changed"), F.max("d").alias("max_abs"), F.sqrt(F.sum(F.col("d") * F.col("d")) / F.sum(F.col("x") * F.col("x"))).alias("l2"), F.corr("x", "y").alias("c"))
    s = s.join(p, F.lit(True), "left")  # one row each
    return s.select("same", R("changed", 9).alias("changed"), R("max_abs", 4).alias("max_abs"), *[R(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], R("l2", 8).alias("relative_l2"), R("c", 8).alias("correlation"))


@query("""WITH p AS (SELECT l_returnflag, l_extendedprice AS x, CASE WHEN l_linenumber < 7 THEN l_quantity * 1000 END AS y FROM lineitem), b AS (SELECT * FROM p WHERE y IS NOT NULL)
SELECT l_returnflag, count(*) AS n, (SELECT count(*) FROM p WHERE y IS NULL AND p.l_returnflag = b.l_returnflag) AS n_missing, count(*) FILTER (x = y) AS n_same_bits, round(max(abs(x - y)), 4) AS max_abs, round(avg((x <> y)::INTEGER), 8) AS changed, round(avg(x - y), 4) AS mean_difference, round(avg(abs(x - y)), 4) AS mean_abs,
round(sqrt(sum((x - y) ^ 2) / sum(x * x)), 8) AS relative_l2, round(corr(x, y), 8) AS correlation, round(stddev_samp(x), 4) AS sd_x FROM b GROUP BY 1""")
def merged_profile(spark, sf_dir):
    """Profiles of two aligned measures by group, from states of two runs over chunks, stored and merged."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_extendedprice").alias("x"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity") * 1000).alias("y"))
    chunk = F.pmod(F.xxhash64("l_orderkey"), F.lit(32)).alias("chunk")
    states, path = accumulate.partial(items.select("*", chunk), "x", "y", ("l_returnflag", "chunk")), files.folder(spark)
    for run, part in (("one", "chunk < 20"), ("two", "chunk >= 20")):
        states.where(part).write.parquet(f"{path}/{run}")
    every = accumulate.merged(spark.read.parquet(f"{path}/one", f"{path}/two"), ("l_returnflag",))
    digits = {"changed": 8, "relative_l2": 8, "correlation": 8}
    return every.select("l_returnflag", "n", "n_missing", "n_same_bits", R("max_abs", 4).alias("max_abs"), *[R(c, digits.get(k, 4)).alias(k) for k, c in accumulate.profile().items()])
