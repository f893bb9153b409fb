"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary rows, give the probability of each byte of a lower-cased word, and of the blank after
it, given the up to DEPTH - 1 bytes before, back to the blank that begins the word. All bytes of all words are counted and
scored, whatever their length. Both models discount their own counts and give what is left to one shared, class-free model of
continuation counts, itself discounted over two shorter contexts. So what either class has seldom seen costs both the same, and only expressions with counts of their own tell the classes apart. A word's evidence
is the difference of its two log-likelihoods; a document compares the length-normalised log-likelihoods of its words, over
the whole text and over its TOP words of greatest difference. A logistic regression on both and on the logarithm of the
length, which says how high the greatest of many differences get by chance, gives the score.

Rows whose crc32(doc_id) mod 5 is 0 teach nothing: remainders 1 to 3 give the counts, all of them; remainder 4 fits the four
logistic weights, on at most CALIBRATION rows. All counts are grouped sums over word and gram tables. The model is a table in
the shared folder with every gram that a class has seen twice; it grows with the input and is neither
broadcast nor collected. Tasks search it in hash blocks of about BLOCK rows: they keep up to HELD of them, and read the
others one after another, for many new words at a time.

Defined cases: null, empty and blank texts have no words, and score what the logistic weights give a document without
evidence; without toxic or without ordinary rows to learn from, the score of every document is the share of toxic rows (0
without any); a null doc_id counts as the empty string; texts and words of any length are scored whole; a score of exactly 0.5
is toxic; repeated rows are scored each; an empty table gives an empty result; other columns, whatever their names, are not
read by ``score`` and come back unchanged from ``drop_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

#: Bytes of the longest gram; words of greatest difference that are compared apart.
DEPTH, TOP = 15, 6
#: Of the occurrences of a gram in a class, what is left to the shared model: the first whole, then this part of each up to the
#: third; so what a class has seen twice or more tells something of its own. And what is taken off shared counts. Of the toxic
#: rows of sf0.1's calibration fold, discounts by counts of counts (0.7 to 1.4) find 76 of 90, whole ones up to the third 81.
DISCOUNT, DISCOUNTED, SHARED_DISCOUNT = 0.9, 3, 0.75
#: Bound of the rows that fit the logistic weights.
CALIBRATION = 20_000
#: Rows of a block of the model, and blocks that a worker keeps.
BLOCK, HELD = 1 << 18, 64
#: Bits of the table that tells most unlabelled rows from labelled ones, at most.
LABEL_BITS = 1 << 26
#: Words that a task sums up before it hands them on.
SUMMED = 500_000
#: Word evidence that a worker remembers, new words that it looks up together, and bytes of words cut to grams together.
REMEMBERED, NEW, CUT = 150_000, 50_000, 1 << 19


def fold_of(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5).cast("int")


def fold(docs: DataFrame) -> DataFrame:
    return docs.withColumn("fold", fold_of(F.col("doc_id")))


ROLLING = common.Rolling(0x5DEECE66D1F3A8B5)
_BYTES = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all bytes of words, with the blank after: hashes of the gram, which is the word up to that byte, its last DEPTH bytes
    at most, and of its context, the last 4 bytes; and how many grams each word has."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    at = np.arange(len(raw))
    blank = raw == 32
    begin = np.maximum.accumulate(np.where(blank, at, 0))[:-1]
    at, sums = at[1:], ROLLING.prefix(_BYTES[raw])
    start = np.maximum(begin, at - DEPTH + 1)
    g = common.mix(ROLLING.slices(sums, start, at + 1)).view(np.int64)
    c = common.mix(ROLLING.slices(sums, start, at)).view(np.int64)
    low = raw[at].astype(np.int64)
    for k in (1, 2, 3):
        low |= np.where(at - begin >= k, raw[np.maximum(at - k, 0)].astype(np.int64), 0) << (8 * k)
    return g, c, low, np.diff(np.flatnonzero(blank))


def cuts(words: list[bytes]) -> Iterator[slice]:
    """Slices of words that hold about CUT bytes."""
    start = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= CUT:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(words):
        yield slice(start, len(words))


GRAMS = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("low", pa.int64()), ("t", pa.int64()), ("o", pa.int64())])


def _word_grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        words, counts = common.text_bytes(part.column(0)), [part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
        for some in cuts(words):
            g, c, low, n = grams(words[some])
            seen, first, place = np.unique(g, return_index=True, return_inverse=True)
            sums = [np.bincount(place, np.repeat(x[some], n), len(seen)).astype(np.int64) for x in counts]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, c[first], low[first], *sums)], schema=GRAMS)


def label_bits(marks: DataFrame) -> np.ndarray:
    """A bit for each hash slot, 8 slots or more a label up to LABEL_BITS, set where a label has it."""
    n = 1 << min(LABEL_BITS.bit_length() - 1, max(6, (8 * marks.count()).bit_length()))
    slots = marks.select(slot(n).alias("slot")).groupBy(F.shiftright("slot", 6).alias("at"))
    found = slots.agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(n >> 6, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out


def may_have(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63)) & 1 == 1


def slot(n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n))


def _pack(parts: Iterator[pa.RecordBatch], seen: np.ndarray) -> Iterator[tuple]:
    """Lower-cased texts, compressed, of rows that may have a label: what is shuffled to the labels."""
    small = zstandard.ZstdCompressor(3)
    for part in parts:
        part = part.filter(pa.array(may_have(seen, part.column(3).to_numpy())))
        for doc_id, number, text in zip(*(c.to_pylist() for c in part.columns[:3])):
            yield doc_id, number, small.compress((text or "").lower().encode())


def _unpack(column: pa.Array) -> Iterator[list[bytes]]:
    large = zstandard.ZstdDecompressor()
    return (large.decompress(z).split() for z in column.to_pylist())


WORDS = pa.schema([("word", pa.binary()), ("t", pa.int64()), ("o", pa.int64())])


def _count_words(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Words by class, summed over up to SUMMED of them before they leave the task."""
    sums: tuple[Counter, Counter] = Counter(), Counter()

    def flush():
        for w in sums[0].keys() | sums[1].keys():
            yield w, sums[1][w], sums[0][w]
        sums[0].clear(), sums[1].clear()

    for part in parts:
        for toxic, words in zip(part.column(0).to_pylist(), _unpack(part.column(1))):
            sums[toxic].update(words)
            if len(sums[0]) + len(sums[1]) > SUMMED:
                yield from flush()
    yield from flush()


def train(labelled: DataFrame, work: common.Scratch, counted: Callable[[], None] = lambda: None) -> DataFrame:
    """Grams with their evidence (kind 0), contexts with that of any unseen byte (kind 1), by block. From labelled(toxic, packed),
    which is not read again once ``counted`` is called."""
    counts = labelled.select("toxic", "packed").mapInArrow(lambda parts: common.batches(_count_words(parts), WORDS), "word binary, t long, o long")
    counts = work.write(counts.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "toxicity-words")
    counted()
    found = counts.mapInArrow(_word_grams, "g long, c long, low long, t long, o long").groupBy("g", "c", "low").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    found = work.write(found, "toxicity-grams")
    work.release(counts)
    v, less = F.col, F.lit(SHARED_DISCOUNT)
    first = lambda x: F.least(v(x), F.lit(1))
    off = lambda x: first(x) + (F.least(v(x), F.lit(DISCOUNTED)) - first(x)) * DISCOUNT

    # the shared model: how many different grams end in 4 bytes, and how many of these in 2
    def continued(below: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
        g = below.groupBy(v("low").bitwiseAND((1 << 8 * size) - 1).alias("low")).agg(F.count(F.lit(1)).alias("n"))
        return g, g.groupBy(F.shiftright("low", 8).alias("before")).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))

    g4, c4 = continued(found, 4)
    g2, c2 = continued(g4, 2)
    share = (v("n") - less) / v("all")
    left = less * v("kinds") / v("all")
    p2 = g2.join(c2, F.shiftright("low", 8) == v("before")).select(v("low").alias("low2"), (share + left / 256).alias("p2"))
    p4 = g4.join(c4, F.shiftright("low", 8) == v("before")).join(p2, v("low").bitwiseAND(0xFFFF) == v("low2"))
    p4 = p4.select("low", (share + left * v("p2")).alias("p4"))
    # each class: its own counts, discounted, over the shared model
    own = found.groupBy("c").agg(*[x for k in "to" for x in (F.sum(k).alias(f"n_{k}"), F.sum(off(k)).alias(f"k_{k}"))])
    rest = {x: F.when(v(f"n_{x}") > 0, v(f"k_{x}") / v(f"n_{x}")).otherwise(1.0) for x in "to"}
    p = {x: F.when(v(f"n_{x}") > 0, (v(x) - off(x)) / v(f"n_{x}")).otherwise(0.0) + rest[x] * v("p4") for x in "to"}
    # grams without a count above the discount have the evidence of unseen ones, and most contexts none
    scored = found.where((v("t") > 1) | (v("o") > 1)).join(own, "c").join(p4, "low").select(F.lit(0).alias("kind"), "g", (F.log(p["t"]) - F.log(p["o"])).cast("float").alias("llr"))
    unseen = own.select(F.lit(1).alias("kind"), v("c").alias("g"), (F.log(rest["t"]) - F.log(rest["o"])).cast("float").alias("llr")).where("llr <> 0")
    flat = work.write(scored.unionAll(unseen), "toxicity-evidence")
    work.release(found)
    blocks = flat.count() // BLOCK + 1
    model = flat.withColumn("block", F.pmod("g", F.lit(blocks)).cast("int")).repartition(blocks, "block").sortWithinPartitions("block", "kind", "g")
    path = work.folder("toxicity-model")
    model.write.option("compression", "zstd").partitionBy("block").parquet(path)
    work.release(flat)
    model = flat.sparkSession.read.schema(model.schema).parquet(path)
    model.scratch_path, model.blocks = path, blocks  # type: ignore[attr-defined]
    return model


def files(model: DataFrame) -> list[list[str]]:
    """The files of each block of a model."""
    out: list[list[str]] = [[] for _ in range(model.blocks)]  # type: ignore[attr-defined]
    for path in model.inputFiles():
        out[int(re.findall(r"/block=(\d+)/", path)[-1])].append(path)
    return out


class Evidence(dict):
    """Differences of the two log-likelihoods by word, computed for many new words at once."""

    def __init__(self, blocks: list[list[str]]):
        self.blocks, self.held = blocks, {}

    def block(self, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hashes of grams and of contexts, each with the evidence, in the order that they were written in."""
        if k in self.held:
            return self.held[k]
        kind, g, llr = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for uri in self.blocks[k]:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as file:
                table = pq.read_table(file, columns=["kind", "g", "llr"])
            for held, name in ((kind, "kind"), (g, "g"), (llr, "llr")):
                held.append(table[name].to_numpy())
        kind, g, llr = map(np.concatenate, (kind, g, llr))
        pa.default_memory_pool().release_unused()
        if len(self.blocks[k]) > 1:  # several files of one block are in order each
            by = np.lexsort((g, kind))
            kind, g, llr = kind[by], g[by], llr[by]
        split = int(np.searchsorted(kind, 1))
        out = [(g[:split], llr[:split]), (g[split:], llr[split:])]
        if len(self.held) < HELD:
            self.held[k] = out
        return out

    def learn(self, new: list[bytes]) -> None:
        """Adds the evidence of these words."""
        for cut in cuts(new):
            g, c, _, n = grams(new[cut])
            # of the gram itself, or else of any unseen byte after its context
            want = (g, c)
            got = [np.full(len(g), np.nan, np.float32), np.zeros(len(g), np.float32)]
            by = [np.argsort(x % len(self.blocks), kind="stable") if len(self.blocks) > 1 else np.arange(len(x)) for x in want]
            ends = [np.cumsum(np.bincount(x % len(self.blocks), minlength=len(self.blocks))) for x in want]
            for k in range(len(self.blocks)):
                for (keys, values), out, x, order, end in zip(self.block(k), got, want, by, ends):
                    here = order[end[k - 1] if k else 0 : end[k]]
                    if len(keys) and len(here):
                        at = np.minimum(np.searchsorted(keys, x[here]), len(keys) - 1)
                        ok = keys[at] == x[here]
                        out[here[ok]] = values[at[ok]]
            each = np.where(np.isnan(got[0]), got[1], got[0])
            self.update(zip(new[cut], np.add.reduceat(each.astype(np.float64), np.cumsum(n) - n).tolist()))

    def of(self, texts: Iterator[list[bytes]]) -> Iterator[np.ndarray]:
        """The evidence of the words of each text; texts wait until NEW words are to be looked up, or as many remembered."""
        waiting: list[list[bytes]] = []
        new: set[bytes] = set()
        size = 0

        def flush() -> Iterator[np.ndarray]:
            self.learn(list(new))
            for words in waiting:
                yield np.fromiter(map(self.__getitem__, words), np.float64, len(words))
            waiting.clear(), new.clear()
            if len(self) > REMEMBERED:
                self.clear()

        for words in texts:
            waiting.append(words)
            new.update(w for w in words if w not in self)
            size += len(words)
            if len(new) > NEW or size > 5 * NEW:
                yield from flush()
                size = 0
        yield from flush()


def features(evidence: np.ndarray) -> tuple[float, float, float]:
    """Length-normalised difference over the document and over its TOP words, and the logarithm of its length."""
    n = len(evidence)
    if not n:
        return 0.0, 0.0, 0.0
    top = np.partition(evidence, n - TOP)[n - TOP :] if n > TOP else evidence
    return float(evidence.sum() / n), float(top.sum() / TOP), float(np.log1p(n))


def measure(docs: DataFrame, model: DataFrame, *named: str) -> DataFrame:
    """(named.., whole, peak, size) for docs(text, named..), where the text may be packed; the named columns are longs."""
    blocks = files(model)
    schema = pa.schema([*((n, pa.int64()) for n in named), ("whole", pa.float64()), ("peak", pa.float64()), ("size", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(blocks)
        for part in parts:
            texts = _unpack(part.column(0)) if pa.types.is_binary(part.column(0).type) else ((t or "").lower().encode().split() for t in part.column(0).to_pylist())
            found = [features(x) for x in evidence.of(texts)]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array([x[i] for x in found], pa.float64()) for i in range(3))], schema=schema)

    return docs.mapInArrow(run, ", ".join([*(f"{n} long" for n in named), "whole double", "peak double", "size double"]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on standardised columns, returned for plain ones; by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * len(y) * np.r_[0, w[1:]] / 10
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(np.r_[1e-9, np.full(len(w) - 1, ridge * len(y) / 10)])
        w = w - np.linalg.solve(h, g)
    return np.r_[w[0] - (w[1:] * mean / scale).sum(), w[1:] / scale]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text)."""
    found = scored(fold(common.first_column(docs, "doc_id", "text")), labels, "doc_id")
    held_out = (fold_of(F.col("doc_id")) == 0).alias("held_out")
    return found.scratch.result(found.select("doc_id", held_out, "score", "predicted"))  # type: ignore[attr-defined]


def scored(docs: DataFrame, labels: DataFrame, *named: str) -> DataFrame:
    """The named columns, which are longs, score and predicted for every row of docs(doc_id, fold, text, ..)."""
    work = common.Scratch(docs.sparkSession)
    marks = labels.select(F.col("doc_id"), F.col("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    schema = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), ("packed", pa.binary())])
    bits = label_bits(marks)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    packed = docs.where("fold > 0 AND doc_id IS NOT NULL").select("doc_id", "fold", "text", slot(64 * len(bits)).alias("slot")).mapInArrow(lambda parts: common.batches(_pack(parts, shared.value), schema, 2_000), "doc_id long, fold int, packed binary")
    known = packed.join(fold(marks).where("fold > 0").drop("fold"), "doc_id").select("packed", "toxic", "fold", F.xxhash64("doc_id").alias("key"))
    known = work.write(known, "toxicity-labelled")
    seen = {(x.toxic, x.fits): x.n for x in known.groupBy("toxic", (F.col("fold") == 4).alias("fits")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if all(seen.get((c, f), 0) for c in (0, 1) for f in (False, True)):
        share = CALIBRATION / sum(seen[c, True] for c in (0, 1))  # a bounded sample, by hash
        rows = known.where("fold = 4").where(F.pmod("key", F.lit(1_000_000)) < int(1_000_000 * min(1.0, share)))
        rows = work.write(rows, "toxicity-fit")
        model = train(known.where("fold < 4"), work, lambda: work.release(known))
        held = measure(rows.select("packed", F.col("toxic").cast("long").alias("toxic")), model, "toxic").toPandas()
        work.release(rows)
        a, b, c, d = (float(v) for v in logistic(held[["whole", "peak", "size"]].to_numpy(), held.toxic.to_numpy().astype(float)))
        found = measure(docs.select("text", *named), model, *named)
        found = work.write(found, "toxicity-measured")  # the model's table goes
        work.release(model)
        value = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(a) + b * F.col("whole") + c * F.col("peak") + d * F.col("size"), F.lit(-30.0)), F.lit(30.0))))
    else:
        n = sum(seen.values())
        found, value = docs.select(*named), F.lit(sum(k for (c, _), k in seen.items() if c == 1) / n if n else 0.0)
        work.release(known)
    return work.result(found.select(*named, value.alias("score")).withColumn("predicted", F.expr("CAST(score >= 0.5 AS int)")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the score doesn't call toxic, with all their columns. A row goes for its own text, whatever rows
    share its doc_id."""
    found = scored(fold(common.first_column(docs, "doc_id", "text").select("doc_id", "text", *common.row_key())), labels, "k", "tag")
    toxic = found.where("predicted = 1").select("k", "tag").distinct()
    return found.scratch.result(common.unpacked(common.rows(docs).join(toxic, ["k", "tag"], "left_anti"), docs))  # type: ignore[attr-defined]


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
