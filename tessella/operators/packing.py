"""Token packing into fixed sequences, and cyclic mixing of streams by closed-form indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a range that are aimed at, and ranges that quantiles cut before each is cut further in even steps.
RANGE_ROWS, CUTS = 1_000_000, 64


def range_of(docs: DataFrame, order: str) -> Column:
    """Number of the range that a row lies in, rising with a numeric column; nulls and what is infinitely small come before
    all ranges, what is infinitely great or no number after them.

    Approximate quantiles cut first, so that outlying values do not leave the others in one range; each range is then cut in
    even steps, whose number grows with the rows.
    """
    whole = dict(docs.dtypes)[order] in ("tinyint", "smallint", "int", "bigint")
    kind, number, end = ("bigint", int, "L") if whole else ("double", float, "D")
    value = F.col(order).cast(kind)
    finite = F.when(F.abs(value.cast("double")) < F.lit(float("inf")), value)
    n, low, high, cuts = docs.agg(F.count(finite), F.min(finite), F.max(finite), F.percentile_approx(finite, [i / CUTS for i in range(1, CUTS)], 100 * CUTS)).first()
    edges = sorted({number(low), *map(number, cuts)}) if n else [number(0)]
    fine = n // (CUTS * RANGE_ROWS) + 1
    widths = [after - edge for edge, after in zip(edges, [*edges[1:], number(high or 0)])]

    def among(a: int, b: int) -> str:
        if b - a == 1:
            past = f"(CAST(`{order}` AS {kind}) - {edges[a]}{end})"
            step = f"{past} div {widths[a] // fine + 1}L" if whole else f"least({fine - 1}, floor({past} / {widths[a] / fine or 1.0}D))"
            return f"{a * fine} + {step}"
        mid = (a + b) // 2
        return f"IF(`{order}` < {edges[mid]}{end}, {among(a, mid)}, {among(mid, b)})"

    before = F.col(order).isNull() | (value.cast("double") == F.lit(float("-inf")))
    return F.when(before, F.lit(-1)).when(finite.isNull(), F.lit(len(edges) * fine)).otherwise(F.expr(among(0, len(edges)))).cast("long")


def offsets(docs: DataFrame, order: str, size: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """docs with start: the sum of the sizes before each, in the order of a numeric column and what breaks its ties, in all
    or in each stratum.

    Two passes: sums of ranges of the order, then running sums within ranges. No window spans a whole stratum.
    """
    ranged = docs.withColumn("_range", range_of(docs, order))
    sums = ranged.groupBy(*by, "_range").agg(F.sum(size).alias("_sum"))
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", *[F.col(c).alias(f"_by_{c}") for c in by], F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*by, "_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = ranged.join(before.withColumnRenamed("_range", "_in"), same)
    found = joined.withColumn("start", F.col("_before") + F.coalesce(F.sum(size).over(w), F.lit(0)))
    return found.drop("_range", "_in", "_before", *[f"_by_{c}" for c in by])


def sequences(docs: DataFrame, order: str, tokens: str, length: int, budget: int, end: str) -> DataFrame:
    """(seq, tokens): tokens of all documents, each followed by ``end``, cut at ``budget`` and dealt in sequences of
    ``length``; documents beyond the budget are never exploded."""
    ended = docs.withColumn("_t", F.concat(F.col(tokens), F.array(F.lit(end)))).withColumn("_n", F.size("_t").cast("long"))
    placed = offsets(ended, order, "_n").where(F.col("start") < budget)
    each = placed.select("start", F.posexplode("_t").alias("i", "token")).withColumn("pos", F.col("start") + F.col("i")).where(F.col("pos") < budget)
    rows = each.groupBy(F.expr(f"pos div {length}").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return rows.select("seq", F.col("t.token").alias("tokens"))


def slot_source(seq: Column, period: int, taken: dict[int, str], rest: str) -> Column:
    """Which stream fills a sequence: by its place in the period, else the rest."""
    out = F.lit(rest)
    for place, name in sorted(taken.items(), reverse=True):
        out = F.when(F.pmod(seq, F.lit(period)) == place, name).otherwise(out)
    return out


def slot_index(seq: Column, period: int, places: list[int]) -> Column:
    """How many sequences before this one lie on these places of the period."""
    inside = F.pmod(seq, F.lit(period))
    partial = F.lit(0)
    for p in places:
        partial = partial + F.when(inside > p, 1).otherwise(0)
    return F.floor(seq / period) * len(places) + partial


def slot_sequence(index: Column, period: int, places: list[int]) -> Column:
    """Where the sequence of that index of a stream goes, when the stream fills these places of the period: the inverse of
    ``slot_index``."""
    at = F.array(*[F.lit(p).cast("long") for p in sorted(places)])
    return F.floor(index / len(places)) * period + F.get(at, F.pmod(index, F.lit(len(places))).cast("int"))


def slots_before(n: int, period: int, places: list[int]) -> int:
    """How many of the first n sequences lie on these places."""
    return n // period * len(places) + sum(p < n % period for p in places)


#: Passes of a wrapping stream that one row stands for as they are dealt to tasks.
PASSES = 64


def windows(docs: DataFrame, order: str, ids: str, length: int, first: int, count: int, wrap: bool = False, size: str | None = None) -> DataFrame:
    """(k, ids): ``count`` windows of ``length`` ids from window ``first`` on, of the ids of all documents in order; k from 0.
    ``size`` names a column with the number of a document's ids, where there is one.

    A stream that wraps begins again after its last id, in the middle of a window too; one that doesn't must be long enough.
    A document is cut where windows begin, and only pieces of windows that are asked for are shuffled, never single ids. A
    short stream may have to begin again very often: its documents are dealt out anew, each with ``PASSES`` passes at a time.
    """
    sized = docs.select(order, F.col(ids).alias("_ids"), F.col(size).cast("long").alias("_n")) if size else docs.select(order, F.col(ids).alias("_ids"), F.size(ids).cast("long").alias("_n"))
    sized = sized.where("_n > 0")
    total = sized.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    low, high = first * length, (first + count) * length
    if high > low and (not total or not wrap and high > total):
        raise ValueError(f"a stream of {total} ids has no {count} windows of {length} from the one numbered {first} on")
    placed = offsets(sized, order, "_n")
    if wrap and total:
        begin, end = low // total, max(high - 1, low) // total
        if end - begin >= PASSES:
            tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            placed = placed.withColumn("_from", F.explode(F.sequence(F.lit(begin), F.lit(end), F.lit(PASSES)))).repartition(tasks, "_from", order)
        else:
            placed = placed.withColumn("_from", F.lit(begin))
        passes = F.sequence("_from", F.least(F.col("_from") + PASSES - 1, F.lit(end)))
        placed = placed.withColumn("_pass", F.explode(passes)).withColumn("start", F.col("start") + F.col("_pass") * total)
    needed = placed.where((F.col("start") < high) & (F.col("start") + F.col("_n") > low))
    span = needed.withColumn("_a", F.greatest("start", F.lit(low))).withColumn("_b", F.least(F.col("start") + F.col("_n"), F.lit(high)))
    cut = F.expr(f"""transform(sequence(_a div {length}, (_b - 1) div {length}), k -> struct(k - {first} AS k, greatest(k * {length}, _a) AS at,
        slice(_ids, CAST(greatest(k * {length}, _a) - start + 1 AS int), CAST(least((k + 1) * {length}, _b) - greatest(k * {length}, _a) AS int)) AS part))""")
    pieces = span.select(F.inline_outer(cut)).where("k IS NOT NULL")
    return pieces.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p")).select("k", F.flatten("p.part").alias("ids"))


def mixed(streams: dict[str, tuple], places: dict[str, list[int]], period: int, length: int, n: int, starts: dict[str, int], wrapping: set[str]) -> DataFrame:
    """(seq, source, source_seq, ids): n sequences, each filled by the stream whose place in the period it is.

    streams: (documents, order, ids) by name, and the column of their sizes where there is one; starts: the window that each begins at, so that a mixture can be continued;
    wrapping: which begin again after their end. Every sequence follows from its stream's window by a closed form.
    """
    if sorted(p for ps in places.values() for p in ps) != list(range(period)):
        raise ValueError("each place of the period must have one stream")
    out = None
    for name, (docs, order, ids, *size) in streams.items():
        count = slots_before(n, period, places[name])
        found = windows(docs, order, ids, length, starts.get(name, 0), count, name in wrapping, *size)
        rows = found.select(slot_sequence(F.col("k"), period, places[name]).cast("long").alias("seq"), F.lit(name).alias("source"), (F.col("k") + starts.get(name, 0)).cast("long").alias("source_seq"), "ids")
        out = rows if out is None else out.unionAll(rows)
    return out
