"""Evaluation readouts: options, shortcuts, branches, nested values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.functions.transforms import hadamard_array
from tessella.operators import joins, screen
from tessella.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)


@query("""WITH o AS (SELECT o_custkey % 50 AS item, o_orderkey % 4 AS opt, -avg(o_totalprice / 1e5) AS score FROM orders GROUP BY 1, 2), i AS (SELECT item, map_from_entries(list((opt, score) ORDER BY opt)) AS m FROM o GROUP BY item HAVING count(*) = 4)
SELECT item, (item % 4) AS gold, round(m[item % 4], 6) AS gold_score, m[item % 4] > greatest(m[(item + 1) % 4], m[(item + 2) % 4], m[(item + 3) % 4]) AS hit FROM i""")
def cloze_scores(spark, sf_dir):
    """Length-normalised option scores of items that have all four options; a tie is a miss."""
    o = table(spark, sf_dir, "orders").groupBy(F.pmod("o_custkey", F.lit(50)).alias("item"), F.pmod("o_orderkey", F.lit(4)).alias("opt")).agg((-F.avg(F.col("o_totalprice") / 1e5)).alias("score"))
    i = o.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("opt", "score"))).alias("t")).where("size(t) = 4").select("item", F.col("t.score").alias("v"))
    gold = F.pmod("item", F.lit(4))
    return i.select("item", gold.alias("gold"), R(F.get("v", gold.cast("int"))).alias("gold_score"), V.strict_hit("v", gold.cast("int")).alias("hit"))


@query("""WITH t AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity, l_extendedprice) AS q, list(l_extendedprice ORDER BY l_linenumber, l_quantity, l_extendedprice) AS p FROM lineitem GROUP BY 1 HAVING count(*) >= 3),
g AS (SELECT l_orderkey, list_position(p, list_max(p)) AS gold, len(q) AS n, q FROM t)
SELECT rule, count(*) AS n, count(*) FILTER (pick = gold) AS hits, round(avg(1.0 / n), 9) AS chance FROM (SELECT gold, n, unnest(['first', 'last', 'middle', 'most', 'least']) AS rule, unnest([1, n, (n + 1) // 2, list_position(q, list_max(q)), list_position(q, list_min(q))]) AS pick FROM g) GROUP BY rule""")
def shortcut_audit(spark, sf_dir):
    """How often rules that do not look at the answer find it, against chance."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))).alias("t")).where("size(t) >= 3")
    g = t.select(F.col("t.l_quantity").alias("q"), F.col("t.l_extendedprice").alias("p"), F.size("t").alias("n"))
    picks = {"first": F.lit(1), "last": F.col("n"), "middle": F.floor((F.col("n") + 1) / 2), "most": F.array_position("q", F.array_max("q")), "least": F.array_position("q", F.array_min("q"))}
    each = g.select("n", F.array_position("p", F.array_max("p")).alias("gold"), F.explode(F.create_map(*[x for k, v in picks.items() for x in (F.lit(k), v.cast("long"))])).alias("rule", "pick"))
    return each.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pick") == F.col("gold")).alias("hits"), R(F.avg(1.0 / F.col("n")), 9).alias("chance"))


@query("""WITH i AS (SELECT l_partkey, min(l_extendedprice) FILTER (l_returnflag = 'A') AS lo1, max(l_extendedprice) FILTER (l_returnflag = 'A') AS hi1, min(l_extendedprice) FILTER (l_returnflag = 'R') AS lo2, max(l_extendedprice) FILTER (l_returnflag = 'R') AS hi2 FROM lineitem GROUP BY 1)
SELECT l_partkey, greatest(lo1, lo2) AS low, least(hi1, hi2) AS high, greatest(lo1, lo2) <= least(hi1, hi2) AS feasible FROM i WHERE lo1 IS NOT NULL AND lo2 IS NOT NULL""")
def common_interval(spark, sf_dir):
    """Whether the ranges of two arms have a value in common."""
    p, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    i = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*[f(F.when(flag == x, p)).alias(f"{n}{k}") for k, x in ((1, "A"), (2, "R")) for n, f in (("lo", F.min), ("hi", F.max))])
    low, high = F.greatest("lo1", "lo2"), F.least("hi1", "hi2")
    return i.where("lo1 IS NOT NULL AND lo2 IS NOT NULL").select("l_partkey", low.alias("low"), high.alias("high"), (low <= high).alias("feasible"))


@query("""WITH s AS (SELECT c_mktsegment AS arm, avg(o_totalprice) AS m, stddev_samp(o_totalprice) / sqrt(count(*)) AS se, avg((o_orderstatus = 'F')::INTEGER) AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), b AS (SELECT m, f FROM s WHERE arm = 'BUILDING')
SELECT arm, CASE WHEN s.f < 0.1 THEN 'insane' WHEN s.m - b.m > 1.96 * se AND s.f >= b.f THEN 'better' WHEN s.m - b.m > 1.96 * se THEN 'traded' WHEN s.m - b.m < -1.96 * se THEN 'worse' ELSE 'level' END AS branch, row_number() OVER (ORDER BY s.m DESC, arm) AS place FROM s, b""")
def decision_branches(spark, sf_dir):
    """A branch for each arm against a baseline, by rules in a fixed order, and the arms' places; arms are few."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = o.groupBy(F.col("c_mktsegment").alias("arm")).agg(F.avg("o_totalprice").alias("m"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("f"))
    base = joins.single(s.where("arm = 'BUILDING'").select(F.col("m").alias("bm"), F.col("f").alias("bf")))
    d, half = F.col("m") - F.col("bm"), 1.96 * F.col("se")
    branch = screen.first_reason([("insane", F.col("f") < 0.1), ("better", (d > half) & (F.col("f") >= F.col("bf"))), ("traded", d > half), ("worse", d < -half)], "level")
    joined = s.crossJoin(base)
    return joined.select("arm", branch.alias("branch"), F.row_number().over(Window.orderBy(F.desc("m"), "arm")).cast("long").alias("place"))


@query("""SELECT event_type, (props ->> '$.k')::INTEGER // 10 AS decile, count(*) AS n, coalesce(max((props ->> '$.absent')::INTEGER), -1) AS absent FROM events GROUP BY 1, 2""")
def nested_values(spark, sf_dir):
    """Values inside JSON with defaults for absent ones."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_type", F.floor(k / 10).cast("int").alias("decile"), F.get_json_object("props", "$.absent").cast("int").alias("absent"))
    return e.groupBy("event_type", "decile").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("absent"), F.lit(-1)).alias("absent"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, round(list_sum(e) / 8, 6) AS first, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i % 2 = 1 THEN e[i] ELSE -e[i] END)) / 8, 6) AS second, round(list_sum(list_transform(e, lambda x: x * x)), 5) AS energy FROM e""")
def hadamard_transform(spark, sf_dir):
    """Orthonormal Walsh-Hadamard transform: first coefficients, and the energy that it keeps."""
    h = table(spark, sf_dir, "embeddings").select("vec_id", hadamard_array(F.col("embedding").cast("array<double>")).alias("h"))
    return h.select("vec_id", R(F.get("h", F.lit(0))).alias("first"), R(F.get("h", F.lit(1))).alias("second"), R(V.total(F.transform("h", lambda x: x * x)), 5).alias("energy"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT doc_id, token, i, sum((token IN ('the', 'de', 'la', 'der'))::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM p)
SELECT doc_id, part::BIGINT AS part, count(*) AS n, sha256(string_agg(token, ' ' ORDER BY i)) AS digest FROM g WHERE token NOT IN ('the', 'de', 'la', 'der') GROUP BY 1, 2""")
def split_at_marks(spark, sf_dir):
    """A stream of tokens cut at end marks, empty parts dropped; within each document."""
    marks = ["the", "de", "la", "der"]
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.words("text")).alias("i", "token"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    g = p.withColumn("part", F.sum(F.col("token").isin(marks).cast("long")).over(w)).where(~F.col("token").isin(marks))
    rows = g.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("i", "token"))).alias("t"))
    return rows.select("doc_id", "part", "n", F.sha2(F.array_join("t.token", " "), 256).alias("digest"))


@query("""WITH p AS (SELECT l_partkey, l_suppkey, max(l_quantity) FILTER (l_linenumber = 1) AS base, max(l_quantity) FILTER (l_linenumber = 2) AS swap FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS pairs, count(*) FILTER (base > 25 AND swap > 25 AND base <> swap) AS tracked FROM p WHERE base IS NOT NULL AND swap IS NOT NULL GROUP BY 1""")
def value_swaps(spark, sf_dir):
    """Groups that have both variants, and in how many both are right and differ."""
    from tessella.operators.joins import by_role

    m = table(spark, sf_dir, "lineitem").where("l_linenumber IN (1, 2)").groupBy("l_partkey", "l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    p = by_role(m, ["l_partkey", "l_suppkey"], "l_linenumber", [1, 2], "q").withColumnsRenamed({"1": "base", "2": "swap"}).where("base IS NOT NULL AND swap IS NOT NULL")
    return p.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("pairs"), F.count_if((F.col("base") > 25) & (F.col("swap") > 25) & (F.col("base") != F.col("swap"))).alias("tracked"))
