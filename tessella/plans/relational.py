"""Aggregations, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import joins
from tessella.plans.registry import query, table

R = lambda c, n=4: F.round(c, n)


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS lines, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice) FILTER (l_discount > 0.05), 2) AS discounted, round(sum(l_extendedprice * l_tax) / sum(l_extendedprice), 8) AS weighted_tax FROM lineitem GROUP BY ALL""")
def multi_measure(spark, sf_dir):
    """Several sums by three keys, one of them conditional, one weighted."""
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("lines"), R(F.sum("l_quantity"), 2).alias("quantity"), R(F.sum(F.when(F.col("l_discount") > 0.05, price)), 2).alias("discounted"), R(F.sum(price * F.col("l_tax")) / F.sum(price), 8).alias("weighted_tax"))


@query("""SELECT p_brand, p_type, grouping(p_brand)::INTEGER AS no_brand, grouping(p_type)::INTEGER AS no_type, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY GROUPING SETS ((), (p_brand), (p_type))""")
def grouping_levels(spark, sf_dir):
    """One accumulator over all, by one key and by another."""
    sets = table(spark, sf_dir, "part").groupingSets([[], [F.col("p_brand")], [F.col("p_type")]], F.col("p_brand"), F.col("p_type"))
    return sets.agg(F.grouping("p_brand").cast("int").alias("no_brand"), F.grouping("p_type").cast("int").alias("no_type"), F.count(F.lit(1)).alias("n"), R(F.avg("p_retailprice")).alias("price"))


@query("""SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS most, count(*) FILTER (value > 100) AS over_100, bool_and(value > 0) AS all_positive, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def exact_quantiles(spark, sf_dir):
    from tessella.operators.quantiles import quantiles

    v, events = F.col("value"), table(spark, sf_dir, "events")
    s = events.groupBy("event_type").agg(R(F.stddev_samp(v), 6).alias("sd"), R(F.min(v), 6).alias("least"), R(F.max(v), 6).alias("most"), F.count_if(v > 100).alias("over_100"), F.every(v > 0).alias("all_positive"), F.countDistinct("user_id").alias("users"))
    p = quantiles(events, "value", [0.5, 0.05, 0.95], ("event_type",), "p").withColumnRenamed("event_type", "type")
    s = s.join(p, F.col("event_type").eqNullSafe(F.col("type")), "left")
    return s.select("event_type", *[R(F.col("p")[i], 6).alias(n) for i, n in enumerate(("median", "p05", "p95"))], "sd", "least", "most", "over_100", "all_positive", "users")


@query("""SELECT CASE WHEN l_discount < 0.025 THEN 'a' WHEN l_discount < 0.05 THEN 'b' WHEN l_discount < 0.075 THEN 'c' ELSE 'd' END AS bin, count(*) AS n, round(avg((l_returnflag = 'R')::INTEGER), 9) AS p_returned, round(sum(l_tax) / nullif(sum(l_discount), 0), 6) AS ratio FROM lineitem GROUP BY 1""")
def conditional_by_bin(spark, sf_dir):
    """A conditional probability and a ratio of sums by magnitude bins; a zero denominator gives null."""
    d = F.col("l_discount")
    bins = F.when(d < 0.025, "a").when(d < 0.05, "b").when(d < 0.075, "c").otherwise("d")
    return table(spark, sf_dir, "lineitem").groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), R(F.avg((F.col("l_returnflag") == "R").cast("int")), 9).alias("p_returned"), R(F.try_divide(F.sum("l_tax"), F.sum(d)), 6).alias("ratio"))


@query("""SELECT p_brand, arg_min(p_name, (p_retailprice, p_name)) FILTER (p_size > 25) AS cheapest, min(p_retailprice) FILTER (p_size > 25) AS price FROM part GROUP BY p_brand""")
def arg_min_tie_by_name(spark, sf_dir):
    """The cheapest part of each brand among those that may be picked, the first by name of equal ones; null where none may."""
    from tessella.operators.decide import least

    may = F.col("p_size") > 25
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(least("p_retailprice", "p_name", may).alias("cheapest"), F.min(F.when(may, F.col("p_retailprice"))).alias("price"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber ROWS UNBOUNDED PRECEDING) AS prefix FROM lineitem)
SELECT l_orderkey, count(*) FILTER (rank <= 2) AS kept, round(sum(l_extendedprice) FILTER (rank <= 2), 2) AS top_two, arg_min(rank, (-round(prefix * prefix / rank, 4), rank)) AS best_k FROM r GROUP BY l_orderkey""")
def rank_in_group(spark, sf_dir):
    """Top two of a group by magnitude, ties to the lower place; and the k that maximises prefix^2 / k, the first of equals."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    r = r.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("prefix", F.sum("l_extendedprice").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    score = -R(F.col("prefix") * F.col("prefix") / F.col("rank"))
    return r.groupBy("l_orderkey").agg(F.count_if(F.col("rank") <= 2).alias("kept"), R(F.sum(F.when(F.col("rank") <= 2, F.col("l_extendedprice"))), 2).alias("top_two"), F.min(F.struct(score.alias("s"), "rank"))["rank"].alias("best_k"))


@query("""SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5""")
def largest_gaps(spark, sf_dir):
    """The five least values, ties by key: a report of fixed size."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(5)


@query("""WITH a AS (SELECT l_suppkey, max((l_returnflag = 'A')::INTEGER) = 1 AS x, max((l_returnflag = 'N' AND l_quantity > 45)::INTEGER) = 1 AS y FROM lineitem GROUP BY 1)
SELECT CASE WHEN x AND NOT y THEN 'lost' WHEN y AND NOT x THEN 'gained' WHEN x THEN 'both' ELSE 'neither' END AS move, count(*) AS n FROM a GROUP BY 1""")
def gained_and_lost(spark, sf_dir):
    """Transitions of items between two arms."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.some(F.col("l_returnflag") == "A").alias("x"), F.some((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 45)).alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.groupBy(F.when(x & ~y, "lost").when(y & ~x, "gained").when(x, "both").otherwise("neither").alias("move")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n_right FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, count(*) AS n_left FROM customer GROUP BY 1)
SELECT k, coalesce(n_left, 0)::BIGINT AS n_left, coalesce(n_right, 0)::BIGINT AS n_right FROM c FULL JOIN o USING (k) WHERE coalesce(n_left, 0) <> 1 OR coalesce(n_right, 0) <> 1""")
def key_set_equality(spark, sf_dir):
    """Keys that two tables do not share one to one."""
    return joins.key_mismatches(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY ALL""")
def star_lookup(spark, sf_dir):
    """Facts against small dimensions, with a semi join on items and an anti join on excluded ones."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    picked = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    barred = customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    facts = table(spark, sf_dir, "orders").join(picked, "o_orderkey", "left_semi").join(barred, "o_custkey", "left_anti")
    dims = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = facts.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(joins.bounded(dims), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), R(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH v AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS one, b.event_type AS other, count(*) AS agree FROM v a JOIN v b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""")
def arm_pair_matrix(spark, sf_dir):
    """How many items each pair of arms shares."""
    v = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("one")).distinct()
    pairs = v.join(v.withColumnRenamed("one", "other"), "user_id").where("one < other")
    return pairs.groupBy("one", "other").agg(F.count(F.lit(1)).alias("agree"))


@query("""SELECT l_partkey, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(avg(abs(l_quantity - l_linenumber)), 6) AS mean_abs, round(min(l_extendedprice / l_quantity), 6) AS least, round(max(l_extendedprice / l_quantity), 6) AS most FROM lineitem GROUP BY 1 HAVING count(*) > 3""")
def correlation_and_ratio(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), R(F.corr(q, p), 6).alias("correlation"), R(F.avg(F.abs(q - F.col("l_linenumber"))), 6).alias("mean_abs"), R(F.min(p / q), 6).alias("least"), R(F.max(p / q), 6).alias("most"))
    return s.where("n > 3").drop("n")


@query("""SELECT s_suppkey, coalesce(lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS next FROM supplier""")
def circular_next(spark, sf_dir):
    """The next one of a group, the first again after the last."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(F.lead("s_suppkey").over(w), F.first("s_suppkey").over(w)).alias("next"))


@query("""WITH p AS (SELECT l_partkey, round(max(l_quantity) FILTER (l_linestatus = 'O'), 2) AS gold, round(max(l_quantity) FILTER (l_linestatus = 'F'), 2) AS wrong FROM lineitem GROUP BY 1)
SELECT l_partkey, gold, wrong, gold - wrong AS margin, gold > wrong AS right FROM p WHERE gold IS NOT NULL AND wrong IS NOT NULL""")
def answer_margin(spark, sf_dir):
    """Gold against wrong by role, in one pivot."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linestatus").agg(F.max("l_quantity").alias("q"))
    p = joins.by_role(m, ["l_partkey"], "l_linestatus", ["O", "F"], "q").where("O IS NOT NULL AND F IS NOT NULL")
    return p.select("l_partkey", R("O", 2).alias("gold"), R("F", 2).alias("wrong"), (F.col("O") - F.col("F")).alias("margin"), (F.col("O") > F.col("F")).alias("right"))


@query("""WITH s AS (SELECT n.n_name AS name, lower(substr(n.n_name, 1, 4)) AS stem FROM nation n) SELECT p_partkey, count(*) AS clashes FROM part, s WHERE contains(lower(p_name), stem) OR p_size = length(name) GROUP BY 1""")
def phrase_clashes(spark, sf_dir):
    """Candidates against an inventory by containment or by a key: a loop over the inventory, which is small and checked."""
    s = joins.bounded(table(spark, sf_dir, "nation").select("n_name", F.lower(F.substring("n_name", 1, 4)).alias("stem")))
    p = table(spark, sf_dir, "part")
    return p.join(s, F.lower("p_name").contains(F.col("stem")) | (F.col("p_size") == F.length("n_name"))).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("clashes"))
