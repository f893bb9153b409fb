"""Screening of texts: reason cascades, gram overlap, first-seen dedupe, TF-IDF similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, bounded
from tessella.sources import files


def first_reason(rules: list[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first rule that holds; rows that meet none are kept. Put costly rules last."""
    reason = F.lit(kept)
    for name, rule in reversed(rules):
        reason = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(reason)
    return reason


def grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram) with every place of every gram."""
    found = df.select(key, T.words(text).alias("_w"))
    return found.select(key, F.explode(T.word_grams("_w", n)).alias("gram"))


def overlap(docs: DataFrame, key: str, text: str, banned: DataFrame, banned_text: str, n: int = 13) -> DataFrame:
    """Per document with grams: how many, how many of them are banned, and their share. Only banned grams are shared out."""
    own = grams(docs, key, text, n)
    known = bounded(grams(banned.select(F.lit(0).alias("_k"), F.col(banned_text)), "_k", banned_text, n).select(F.col("gram").alias("banned")).distinct())
    marked = own.join(known, F.col("gram") == F.col("banned"), "left")
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("n_grams"), F.count("banned").alias("hits"), F.avg(F.col("banned").isNotNull().cast("double")).alias("fraction"))


#: Words that a phrase is looked up by, of a phrase at most, and of the gram that stands for a longer text.
HEAD, WHOLE, GRAM = 4, 12, 13


def phrases(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, phrase) of what documents are searched for: texts of 4 to 12 words whole, every 13-word gram of longer ones;
    and every text for equality, shorter ones for nothing else."""
    found = items.select(key, T.words(text).alias("_w"))
    whole = found.where(F.size("_w").between(HEAD, WHOLE)).select(key, F.lit("phrase").alias("kind"), F.array_join("_w", " ").alias("phrase"))
    grams = found.where(F.size("_w") >= GRAM).select(key, F.lit("gram").alias("kind"), F.explode(F.array_distinct(T.word_grams("_w", GRAM))).alias("phrase"))
    same = found.where(F.size("_w") > 0).select(key, F.lit("equal").alias("kind"), F.array_join("_w", " ").alias("phrase"))
    return whole.unionAll(grams).unionAll(same)


def phrase_matches(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(item, key, kind, place) of the first place, in words from 0, where a document holds an item's phrase, by kind.

    One pass over the documents takes a hash of every four words, and one of each whole text: where none of a phrase's
    beginning, or of an item's text, is equal, the place goes before anything is shuffled, if these are few enough to be
    broadcast. The places that are left go to a table; only their documents are cut into words again, and their words are
    compared there. Equality is decided by digests of whole texts.
    """
    wanted = phrases(items, item, item_text)
    inner = wanted.where("kind <> 'equal'").select(item, "kind", "phrase", F.substring_index("phrase", " ", HEAD).alias("head"))
    same = wanted.where("kind = 'equal'")
    hashed = lambda w: "xxhash64(" + ", ".join(w.format(k) for k in range(HEAD)) + ")"
    begins = inner.select(F.split("head", " ").alias("_h")).select(F.expr(hashed("get(_h, {})")).alias("h"))
    asked = begins.unionAll(same.select(F.xxhash64(F.split("phrase", " ")))).distinct()
    words = docs.select(F.col(key), T.words(text).alias("_w"))
    places = F.expr(f"""CASE WHEN size(_w) >= {HEAD} THEN array_append(transform(sequence(0, size(_w) - {HEAD}), i -> struct(i AS place, {hashed("get(_w, i + {})")} AS h)), struct(-1 AS place, xxhash64(_w) AS h))
        WHEN size(_w) > 0 THEN array(struct(-1 AS place, xxhash64(_w) AS h)) END""")
    at = words.select(key, F.inline_outer(places)).where("h IS NOT NULL").join(bounded(asked), "h", "left_semi")
    path, left = files.folder(docs.sparkSession) + "/places", at.groupBy(F.col(key).alias("_key")).agg(F.collect_list("place").alias("_at"))
    left.write.parquet(path)
    left = bounded(docs.sparkSession.read.schema(left.schema).parquet(path))
    again = docs.join(left, F.col(key).eqNullSafe(F.col("_key"))).select(key, T.words(text).alias("_w"), "_at")
    told = F.expr(f"transform(filter(_at, i -> i >= 0), i -> struct(i AS place, array_join(slice(_w, i + 1, {HEAD}), ' ') AS head, array_join(slice(_w, i + 1, {GRAM}), ' ') AS tail))")
    begun = again.select(key, F.inline_outer(told)).where("head IS NOT NULL")
    held = begun.join(bounded(inner), "head").where(F.startswith(F.concat("tail", F.lit(" ")), F.concat("phrase", F.lit(" "))))
    whole = again.where(F.array_contains("_at", -1)).select(key, F.sha2(F.array_join("_w", " "), 256).alias("digest"))
    equal = whole.join(bounded(same.select(item, F.sha2("phrase", 256).alias("digest"))), "digest")
    every = held.select(item, key, "kind", "place").unionAll(equal.select(item, key, F.lit("equal"), F.lit(0)))
    return every.groupBy(item, key, "kind").agg(F.min("place").alias("place"))


def first_seen(df: DataFrame, by: str, order: str, passed: Column) -> DataFrame:
    """df with _first: whether a row is the first of its kind among the rows that pass; only these count as seen."""
    passed = F.coalesce(passed, F.lit(False))
    least = df.where(passed).groupBy(by).agg(F.min(order).alias("_least"))
    joined = df.join(least, by, "left")
    return joined.withColumn("_first", passed & (F.col(order) == F.col("_least"))).drop("_least")


def _terms(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(key, more, _t): words of two characters or more and pairs of them, each as often as it occurs."""
    found = df.select(key, *more, F.filter(T.words(text), lambda w: F.length(w) > 1).alias("_w"))
    pairs = F.expr("CASE WHEN size(_w) > 1 THEN transform(sequence(0, size(_w) - 2), i -> concat(_w[i], ' ', _w[i + 1])) ELSE array() END")
    return found.select(key, *more, F.concat("_w", pairs).alias("_t"))


def counted_terms(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(key, _c, more): the terms of each row with their counts, as an array of (term, tf); runs of the sorted terms."""
    names = [f"_more{i}" for i in range(len(more))]
    beside = df.select(key, text, *[c.alias(n) for c, n in zip(more, names)])
    ordered = _terms(beside, key, text, *names).select(key, *names, F.sort_array("_t").alias("_t"))
    starts = ordered.select(key, *names, "_t", F.expr("CASE WHEN size(_t) > 0 THEN filter(sequence(0, size(_t) - 1), i -> i = 0 OR _t[i] <> _t[i - 1]) END").alias("_s"))
    return starts.select(key, *names, F.expr("transform(_s, (s, j) -> struct(_t[s] AS term, coalesce(get(_s, j + 1), size(_t)) - s AS tf))").alias("_c"))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf), counted where the rows lie.

    The generator is an outer one: of others Spark infers a filter, whose pushed copy would sort a row's terms once a term.
    """
    return counted_terms(df, key, text).select(key, F.inline_outer("_c")).where("term IS NOT NULL")


def smooth_idf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, idf) over all rows of df, whose keys differ."""
    n = df.count()
    seen = _terms(df, key, text).select(F.explode_outer(F.array_distinct("_t")).alias("term")).where("term IS NOT NULL").groupBy("term")
    return seen.agg((F.log((1 + F.lit(n)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))


def term_weights(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, w): sublinear tf times idf; counts are shuffled once, by term."""
    return counts.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, w): term weights at length one (L2)."""
    weights = term_weights(term_counts(df, key, text), smooth_idf(df, key, text), key)
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


#: References of a block, whose index a task holds; rows scored against it at a time; and the share of a block's references
#: from which on a term counts as common.
REFERENCES, ROWS_AT_ONCE, COMMON = 1024, 256, 0.05


class ReferenceIndex:
    """References of one block at length one: postings of rare terms, a matrix of common ones and what it adds at most."""

    def __init__(self, terms: list, weights: list, common: float = COMMON):
        sizes = np.array([len(x) for x in terms])
        flat, w, of = pa.concat_arrays(terms), np.concatenate(weights), np.repeat(np.arange(len(terms)), sizes)
        w = w / np.sqrt(np.bincount(of, w * w, len(terms)))[of]
        self.n = len(terms)
        coded = flat.dictionary_encode()
        self.terms, code = coded.dictionary, coded.indices.to_numpy()
        held = np.bincount(code, minlength=len(self.terms))
        order = np.argsort(code, kind="stable")
        self.start, self.refs, self.w = np.r_[0, np.cumsum(held)], of[order], w[order]
        self.column = np.where(held > common * self.n, np.cumsum(held > common * self.n) - 1, -1)
        self.matrix = np.zeros((int(self.column.max(initial=-1)) + 1, self.n))
        at = self.column[code]
        self.matrix[at[at >= 0], of[at >= 0]] = w[at >= 0]
        self.most = np.sqrt((self.matrix**2).sum(0))

    def best(self, terms: list, weights: list) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, the greatest dot product with a reference, and with how many it was formed whole.

        Products over rare terms come first. What common terms can add to one is bounded by the lengths of both sides there;
        references whose bound is below the best so far are passed over.
        """
        sizes = np.array([len(x) for x in terms])
        code = pc.index_in(pa.concat_arrays(terms), self.terms).fill_null(-1).to_numpy()
        w, row = np.concatenate(weights), np.repeat(np.arange(len(terms)), sizes)
        w, row, code = w[code >= 0], row[code >= 0], code[code >= 0]
        rare = self.column[code] < 0
        length = (self.start[code + 1] - self.start[code])[rare]
        at = np.repeat(self.start[code[rare]] - np.r_[0, np.cumsum(length)][:-1], length) + np.arange(length.sum())
        pair = np.repeat(row[rare], length) * self.n + self.refs[at]
        dots = np.bincount(pair, np.repeat(w[rare], length) * self.w[at], len(terms) * self.n).reshape(len(terms), self.n)
        own = np.zeros((len(terms), len(self.matrix)))
        own[row[~rare], self.column[code[~rare]]] = w[~rare]
        bound = dots + np.outer(np.sqrt((own**2).sum(1)), self.most)
        alive = (bound * (1 + 1e-12) >= dots.max(1, initial=0)[:, None]) & (bound > 0)
        count = alive.sum(1)
        best = np.zeros(len(terms))
        many = count * 8 > self.n
        if many.any():
            best[many] = np.where(alive[many], dots[many] + own[many] @ self.matrix, 0).max(1, initial=0)
        i, r = np.nonzero(alive & ~many[:, None])
        np.maximum.at(best, i, dots[i, r] + np.einsum("ij,ji->i", own[i], self.matrix[:, r]))
        return best, count


def frequent_from(seen: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> int:
    """The least power of two such that the terms of seen(term, n) with an n of it or more are at most ``rows``, of at most
    ``size`` bytes with 32 beside each. Counted by powers; no term passes the driver."""
    level = F.expr("CAST(length(bin(n)) - 1 AS int)").alias("level")
    levels = seen.groupBy(level).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("term") + 32).alias("bytes")).collect()
    cut, terms, held = 63, 0, 0
    for x in sorted(levels, key=lambda x: -x["level"]):
        terms, held = terms + x["rows"], held + x["bytes"]
        if terms > rows or held > size:
            break
        cut = x["level"]
    return 1 << min(cut, 62)


def greatest_cosine(df: DataFrame, key: str, text: str, reference: Column) -> DataFrame:
    """(key, cosine, pairs): for each row with terms that is no reference, its greatest cosine with one, and how many pairs were
    formed for it. Term weights are those of ``tfidf``.

    Terms are cut and counted once, into a table in the shared folder. The idf of the most frequent terms, as many as may be
    broadcast, goes to the rows; only rows of other terms are shuffled to meet theirs. Rows keep only the terms that references
    have too, in one row each, and are dealt to parts; references are dealt to blocks of bounded size, each of which goes to
    every part. A task holds one block's index and lets rows pass it.
    """
    held, spark = F.struct("term", "w"), df.sparkSession
    path = files.folder(spark)

    def kept(table: DataFrame, name: str) -> DataFrame:
        table.write.option("compression", "zstd").parquet(f"{path}/{name}")
        return spark.read.schema(table.schema).parquet(f"{path}/{name}")

    counted = kept(counted_terms(df, key, text, reference).withColumnRenamed("_more0", "_ref"), "terms")
    each = counted.select(key, "_ref", F.inline_outer("_c")).where("term IS NOT NULL")
    seen = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("_ref"), F.lit(False)).alias("_known"))
    idf = kept(seen.withColumn("idf", F.log((1 + F.lit(counted.count())) / (1 + F.col("n"))) + 1), "idf")
    refs = term_weights(each.where("_ref"), idf.where("_known"), key).groupBy(key).agg(F.collect_list(held).alias("_v"))
    often = frequent_from(idf)
    near = each.where("NOT _ref").join(F.broadcast(idf.where(F.col("n") >= often).drop("n")), "term", "left")  # bounded by frequent_from
    far = near.where("idf IS NULL").select(key, "term", "tf").join(idf.where(F.col("n") < often), "term")
    both = near.where("idf IS NOT NULL").select(key, "term", "tf", "idf", "_known").unionAll(far.select(key, "term", "tf", "idf", "_known"))
    weights = both.select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"), "_known")
    lists = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"), F.collect_list(F.when(F.col("_known"), held)).alias("_v"))
    blocks = max(-(-counted.where("_ref").count() // REFERENCES), 1)
    # more parts than tasks, as parts are hashed to tasks
    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    tagged = [F.col("_v.term").alias("terms"), F.col("_v.w").alias("weights")]
    left = refs.select(every(parts).alias("part"), of(blocks).alias("block"), F.lit(0).alias("side"), F.col(key), F.lit(None).cast("double").alias("norm"), *tagged)
    right = lists.select(of(parts).alias("part"), every(blocks).alias("block"), F.lit(1).alias("side"), F.col(key), F.col("_norm").alias("norm"), *tagged)
    kind = df.schema[key].dataType.simpleString()
    schema = f"name {kind}, cosine double, pairs long"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, terms, values, index = None, [], [], None
        split = lambda column: [column.values.slice(a, b - a) for a, b in zip(column.offsets.to_pylist(), column.offsets.to_pylist()[1:])]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                cell = list(zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("side").to_pylist()))
                edges = [0, *(i for i in range(1, len(cell)) if cell[i] != cell[i - 1]), len(cell)]
                for a, b in zip(edges, edges[1:]):
                    part = batch.slice(a, b - a)
                    t, v = split(part.column("terms")), [x.to_numpy() for x in split(part.column("weights"))]
                    if cell[a][:2] != at:
                        at, terms, values, index = cell[a][:2], [], [], None
                    if cell[a][2] == 0:
                        terms += t
                        values += v
                        continue
                    best, n = np.zeros(len(t)), np.zeros(len(t), np.int64)
                    if terms and index is None:
                        index = ReferenceIndex(terms, values)
                    if index is not None:
                        best, n = index.best(t, v)
                    yield pa.RecordBatch.from_arrays([part.column(key), pa.array(best / part.column("norm").to_numpy()), pa.array(n)], names=["name", "cosine", "pairs"])

    met = left.unionByName(right).repartition(max(parts // 4, 1), "part").sortWithinPartitions("part", "block", "side")
    found = met.mapInArrow(scored, schema)
    return found.groupBy(F.col("name").alias(key)).agg(F.max("cosine").alias("cosine"), F.sum("pairs").alias("pairs"))


def hash_ordered(df: DataFrame, strata: list[str], key: str, seed: str, k: int) -> DataFrame:
    """k rows of each stratum in the order of SHA-256(seed:key), the same on every machine and at every partitioning."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    w = Window.partitionBy(*strata).orderBy("_order")
    return df.withColumn("_order", order).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_order")
