"""Language identification of web pages by Bayesian evidence fusion.

The text of a page has a likelihood under each language: byte trigrams, hashed to SLOTS, counted over all documents by their
language. To it come two pieces of evidence: the language that the markup declares, and a language code in the address'
path; and a prior of the host, smoothed over the prior of its address suffix (the last label of the host name), which is
smoothed over that of all pages. How far declarations, path codes, suffixes and hosts go with languages is not assumed but
counted: text-only posteriors are summed per declaration, code, suffix and host in grouped aggregations, and a page's own
part is taken out of its host's sum. Sums and priors are tables; those of declarations, codes and suffixes are joined as
Spark sees fit by their size, that of hosts by a shuffled join, which splits hot hosts.

Defined cases: a null, empty or text-free page adds nothing to the sums, and is judged by its address and declaration; a null
or unusable url has the empty host and suffix; unknown declarations count as any other; ties go to the language that comes
first in the alphabet; without a document that has a language the result is null; pages of any length are read whole;
repeated pages count each; no pages give no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

#: Slots of hashed trigrams; slots in one row of a sum. The model grows with the number of languages, not with that of rows.
SLOTS, SLICE = 1 << 14, 1 << 10
#: Weight of one trigram against one piece of other evidence (neighbouring trigrams tell much the same).
WEIGHT = 0.3
#: Pages that the suffix's prior is worth for a host, and that the prior of all is worth for a suffix; smoothing of evidence.
HOST_PRIOR, SUFFIX_PRIOR, SMOOTH = 5.0, 20.0, 0.5

MARKUP = re.compile(r"<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+)", re.I)
PATH_CODE = re.compile(r"/([a-z]{2,3})(?:[-_][a-z]{2,4})?(?=/)")


def slots(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    if len(raw) < 5:
        return np.zeros(0, np.int64)
    key = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(0x9E3779B1)
    return (key >> np.uint32(32 - 14)).astype(np.int64)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of trigrams, from all rows of docs(text, lang). A table of fixed size."""

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(slots(text), minlength=SLOTS)
        for lang, n in sums.items():
            for i, part in enumerate(n.reshape(-1, SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([i]), pa.array([part.astype(np.int64).tobytes()], pa.binary())], names=["lang", "i", "n"])

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for part in parts:
            for lang, i, n in zip(*(c.to_pylist() for c in part.columns)):
                sums[lang, i] = sums.get((lang, i), 0) + np.frombuffer(n, np.int64)
        for (lang, i), n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([i]), pa.array([n.tobytes()], pa.binary())], names=["lang", "i", "n"])

    ddl = "lang string, i long, n binary"
    rows = docs.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(tally, ddl).repartition("lang", "i").mapInArrow(total, ddl).collect()
    names = sorted({r.lang for r in rows})
    counts = np.zeros((len(names), SLOTS // SLICE, SLICE))
    for r in rows:
        counts[names.index(r.lang), r.i] = np.frombuffer(r.n, np.int64)
    counts = counts.reshape(len(names), SLOTS) + 0.1
    return names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


FEATURES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("suffix", pa.string()), ("declared", pa.string()), ("code", pa.string()), ("ll", pa.list_(pa.float64())), ("r", pa.list_(pa.float64()))])
FEATURES_DDL = "page_id long, url string, host string, suffix string, declared string, code string, ll array<double>, r array<double>"


def address(url: str | None) -> tuple[str, str, str]:
    """Host, suffix and path code of a url."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return "", "", ""
    code = PATH_CODE.match((parts.path or "").lower() + "/")
    return host, host.rpartition(".")[2], code[1] if code else ""


def features(pages: DataFrame, model: np.ndarray, work: common.Scratch) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        table = shared.value.T.copy()
        for part in parts:
            for page_id, url, page in zip(*(c.to_pylist() for c in part.columns)):
                page = page or ""
                found = slots(" ".join(html.unescape(MARKUP.sub(" ", page)).split()))
                ll = table[found].sum(0, dtype=np.float64) * WEIGHT
                if len(found):
                    r = np.exp(ll - ll.max())
                    r /= r.sum()
                else:
                    r = np.zeros(len(ll))
                declared = DECLARED.search(page)
                yield page_id, url, *address(url)[:2], declared[1].lower() if declared else "", address(url)[2], ll.tolist(), r.tolist()

    return work.write(pages.mapInArrow(lambda parts: common.batches(rows(parts), FEATURES, 2_000), FEATURES_DDL), "language-features")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, url, lang, its posterior, and text_lang, what the text alone says, for every row of pages."""
    work, pages = common.Scratch(pages.sparkSession), common.first_column(pages, "page_id", "url", "html")
    names, model = train(docs)
    if not names:
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"))
    found, n = features(pages, model, work), len(names)

    def sums(by: str, name: str) -> DataFrame:
        return work.write(found.groupBy(by).agg(F.array(*[F.sum(F.get("r", F.lit(i))) for i in range(n)]).alias(name)), f"language-{name}")

    every = found.agg(F.array(*[F.coalesce(F.sum(F.get("r", F.lit(i))), F.lit(0.0)) for i in range(n)])).first()[0]
    whole = sum(every)
    prior = F.array(*[F.lit((x + 1) / (whole + n)) for x in every])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def smoothed(counts: Column, over: Column, weight: float) -> Column:
        return F.zip_with(counts, over, lambda x, p: x + weight * p)

    suffixes = sums("suffix", "s").select("suffix", smoothed(F.col("s"), prior, SUFFIX_PRIOR).alias("s"))
    suffixes = suffixes.select("suffix", F.transform("s", lambda x: x / total(F.col("s"))).alias("suffix_prior"))
    declared, codes, hosts = sums("declared", "d"), sums("code", "p"), sums("host", "h")
    joined = found.join(hosts, "host").join(suffixes, "suffix").join(declared, "declared").join(codes, "code")
    # the host without this page, over the suffix; evidence given the language
    joined = joined.withColumn("h", smoothed(F.zip_with("h", "r", lambda x, r: F.greatest(x - r, F.lit(0.0))), F.col("suffix_prior"), HOST_PRIOR))
    given = lambda c: F.transform(F.zip_with(c, F.array(*map(F.lit, every)), lambda x, e: (x + SMOOTH) / (e + 2 * SMOOTH)), lambda x: F.log(x))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    silent = lambda c, a: F.when(F.col(c) == "", F.array(*[F.lit(0.0)] * n)).otherwise(given(a))
    score = plus(plus(F.col("ll"), F.transform("h", lambda x: F.log(x))), plus(silent("declared", "d"), silent("code", "p")))
    joined = joined.select("page_id", "url", "r", score.alias("score"))
    at = lambda a: F.get(F.array(*map(F.lit, names)), (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    spread = F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("score")))
    out = joined.select("page_id", "url", at(F.col("score")).alias("lang"), (1 / spread).alias("posterior"), F.when(total(F.col("r")) > 0, at(F.col("r"))).alias("text_lang"))
    out = work.write(out, "language-result")
    work.close(out)
    return work.result(out)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "documents"))
