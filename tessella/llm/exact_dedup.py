"""Exact dedup by two passes of Bloom filters, in DataFrame functions only.

Texts are equal when they are identical after A-Z are lower-cased; SHA-256 of that form stands for them.

First pass, a counting filter: as many words of fifteen 4-bit counters as there are rows. A digest adds one to three counters
of one word, so that a word is a sum of bigints, which Spark adds up before it shuffles anything; a word that more than
fifteen rows meet counts as full. A counter of two or more may be that of a repeated digest. Second pass, a plain filter of
those counters alone: bitmaps of 4 KB, broadcast. Their number grows with the counters, up to ``FILTER_BITS`` bits (128 MB),
which is the bound of the broadcast; beyond it the filter lets more single rows through, and nothing else changes. A row all of
whose three bits are set is possibly repeated: only such rows are shuffled and grouped by their whole digest, which settles
what is equal; all other rows pass straight through to the result.

Groups with a thousandth of the shuffled rows or more, of which there are at most a thousand, are told to their rows by a
broadcast; all others hold less than a task's share, so that no key of the join is hot. Counts and the row that stays are
aggregated before shuffling.

Defined cases: null counts as the empty text, and both are one group; of equal texts the greatest doc_id stays, a null doc_id
only where all are null; of rows that share that doc_id too one stays, whichever; texts of any length are read whole; an
empty table gives an empty result; columns beside doc_id and text, whatever their names, are not read by ``mark`` and are
carried along by ``keep_one``.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

#: Counters of a digest, each among so many of its word.
PROBES, SLOTS = 3, 5
#: Bits of a bitmap, fixed by the aggregate that makes it; of the whole second filter at most; and for each counter in it.
BITMAP, FILTER_BITS, BITS_EACH = 32_768, 1 << 30, 16
#: A group with this share of the possibly repeated rows is told by a broadcast, so that at most its inverse are.
HOT_SHARE = 0.001


def digest(text: Column | str) -> Column:
    """SHA-256 of a text whose A-Z are lower-cased, as bytes; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), 256))


def _word(sha: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(words))


def _slots(sha: Column) -> list[Column]:
    """The counters of a digest within its word: one of each five, so that they differ."""
    other = F.xxhash64(sha, F.lit(1))
    return [(F.pmod(F.shiftright(other, 16 * i), F.lit(SLOTS)) + SLOTS * i).cast("int") for i in range(PROBES)]


def _place(word: Column, slot: Column) -> Column:
    """The bit of a counter in its bitmap."""
    return F.pmod(F.xxhash64(word, slot), F.lit(BITMAP))


def counters_met_twice(digests: DataFrame, words: int) -> DataFrame:
    """First pass: (word, slot) of the counters that two rows of digests(sha) or more have met."""
    one = reduce(Column.__add__, [F.call_function("shiftleft", F.lit(1).cast("long"), 4 * s) for s in _slots(F.col("sha"))])
    sums = digests.select(_word(F.col("sha"), words).alias("word"), one.alias("one")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.try_sum("one").alias("sum"))
    # fifteen counters of four bits: none runs over before the sixteenth row
    twice = F.expr(f"filter(sequence(0, {PROBES * SLOTS - 1}), j -> n > 15 OR (shiftright(sum, 4 * j) & 15) > 1)")
    return sums.where("n > 1").select("word", F.explode(twice).alias("slot"))


def repeated_filter(digests: DataFrame, work: common.Scratch) -> tuple[DataFrame, int, int]:
    """Both passes' filters for digests(sha): the second as (bucket, bits), its number of buckets, and the words of the first."""
    words = max(digests.count(), 1)
    twice = work.write(counters_met_twice(digests, words), "met-twice")
    buckets = min(max(-(-twice.count() * BITS_EACH // BITMAP), 1), FILTER_BITS // BITMAP)
    bits = twice.select(F.pmod("word", F.lit(buckets)).alias("bucket"), _place(F.col("word"), F.col("slot")).alias("place"))
    made = bits.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    return work.write(made, "repeated-filter"), buckets, words


def possibly_repeated(df: DataFrame, found: tuple[DataFrame, int, int]) -> DataFrame:
    """df(sha, ..) with maybe: false where the digest is surely met once. Nothing of df is shuffled."""
    bitmaps, buckets, words = found
    marked = df.withColumn("_word", _word(F.col("sha"), words)).withColumn("bucket", F.pmod("_word", F.lit(buckets)))
    joined = marked.join(F.broadcast(bitmaps), "bucket", "left")

    def is_set(slot: Column) -> Column:
        place = _place(F.col("_word"), slot)
        byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1

    maybe = reduce(Column.__and__, [is_set(s) for s in _slots(F.col("sha"))])
    return joined.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("bits", "bucket", "_word")


def mark(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): keep_id, group_size, kept and text_sha256.

    Texts are read once: what follows works on a table of doc_id, digest and a number that tells rows apart.
    """
    work = common.Scratch(docs.sparkSession)
    rows = work.write(docs.select("doc_id", digest("text").alias("sha"), F.monotonically_increasing_id().alias("row")), "digests")
    flagged = possibly_repeated(rows, repeated_filter(rows.select("sha"), work))
    single = flagged.where(~F.col("maybe")).select("doc_id", "sha", "row", F.lit(1).cast("long").alias("n"), F.struct("doc_id", "row").alias("last"))
    some = work.write(flagged.where("maybe").drop("maybe"), "possibly-repeated")
    groups = work.write(some.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("last")), "groups")
    least = F.lit(HOT_SHARE * some.count())
    hot = F.broadcast(groups.where(F.col("n") >= least).select("sha", F.struct("n", "last").alias("of")))
    told = some.join(hot, "sha", "left")
    rest = told.where("of IS NULL").drop("of").join(groups.where(F.col("n") < least), "sha")
    many = told.where("of IS NOT NULL").select("doc_id", "sha", "row", "of.n", "of.last")
    whole = single.unionByName(many).unionByName(rest.select("doc_id", "sha", "row", "n", "last"))
    kept = F.col("last.row") == F.col("row")
    return work.result(whole.select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, whole; rows that are surely single are not shuffled."""
    work = common.Scratch(docs.sparkSession)
    # names of its own, so that no column of docs meets them
    packed = docs.select(digest("text").alias("sha"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    flagged = possibly_repeated(packed, repeated_filter(packed.select("sha"), work))
    order = F.struct(F.col("row.doc_id"), F.xxhash64("row.text"))
    grouped = flagged.where("maybe").groupBy("sha").agg(F.max_by("row", order).alias("row")).select("row")
    return work.result(common.unpacked(flagged.where(~F.col("maybe")).select("row").unionByName(grouped), docs))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(common.table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)"""
