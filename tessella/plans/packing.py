"""Packing, mixing and ternary codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import codes
from tessella.functions import text as T
from tessella.operators import packing
from tessella.plans.registry import query, spread, table
from tessella.sources import files, ranges


@query(r"""
WITH t AS (SELECT doc_id, list_concat(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['<eos>']) AS t FROM documents),
o AS (SELECT *, coalesce(sum(len(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t),
e AS (SELECT start + i - 1 AS pos, t[i] AS token FROM (SELECT start, t, unnest(range(1, len(t) + 1)) AS i FROM o WHERE start < (SELECT sum(len(t)) // 2 FROM t))),
s AS (SELECT pos // 1024 AS seq, list(token ORDER BY pos) AS tokens FROM e WHERE pos < (SELECT sum(len(t)) // 2 FROM t) GROUP BY 1)
SELECT seq, len(tokens)::INTEGER AS n, sha256(array_to_string(tokens, ' ')) AS digest FROM s""")
def pack_sequences(spark, sf_dir):
    """Words of all documents in order, each ended, in sequences of 1024 up to half of all tokens."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.words("text").alias("w"))
    budget = (docs.agg(F.coalesce(F.sum(F.size("w") + 1), F.lit(0))).first()[0]) // 2
    s = packing.sequences(docs, "doc_id", "w", 1024, budget, "<eos>")
    return s.select("seq", F.size("tokens").alias("n"), F.sha2(F.array_join("tokens", " "), 256).alias("digest"))


#: Ids of a sequence, and sequences of a file.
LENGTH, FILE = 64, 4096
PLACES = {"chat": [3, 7, 11, 15], "choice": [14], "web": [p for p in range(14) if p % 4 != 3]}
IDS = r"""list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: ('0x' || md5(w)[1:8])::BIGINT)"""
# position by position: which window of which stream, then which id of that stream, around its end where it wraps
MIXED = f"""
w AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, id FROM (SELECT doc_id, unnest(list_append(t, 0)) AS id, unnest(range(len(t) + 1)) AS i FROM (SELECT doc_id, {IDS.format('text')} AS t FROM documents))),
c AS (SELECT row_number() OVER (ORDER BY conv_id, turn, i) - 1 AS pos, id FROM (SELECT conv_id, turn, unnest(list_append(t, 0)) AS id, unnest(range(len(t) + 1)) AS i FROM (SELECT conv_id, turn, {IDS.format('text')} AS t FROM conversations WHERE role IN ('user', 'assistant')))),
b AS (SELECT row_number() OVER (ORDER BY item_id, i) - 1 AS pos, id FROM (SELECT item_id, unnest(list_append(t, 0)) AS id, unnest(range(len(t) + 1)) AS i FROM (SELECT item_id, {IDS.format('text')} AS t FROM benchmark))),
z AS (SELECT (SELECT count(*) FROM w) // {LENGTH} AS all_, (SELECT count(*) FROM w) // {LENGTH} // 50 AS monitor),
n AS (SELECT monitor, ((all_ - monitor) // 11) * 16 AS n FROM z)"""


def source_words(spark, sf_dir, name: str):
    """(order, w) of the words of a stream's texts, and the name of its order: web documents, chat turns or choice items."""
    source, order = {"web": ("documents", "doc_id"), "chat": ("conversations", "key"), "choice": ("benchmark", "item_id")}[name]
    docs = table(spark, sf_dir, source)
    if name == "chat":
        docs = docs.where("role IN ('user', 'assistant')").withColumn("key", F.col("conv_id") * (1 << 20) + F.col("turn"))
    return spread(docs.select(order, "text")).select(order, T.words("text").alias("w")), order


def stream(spark, sf_dir, name: str) -> tuple:
    """(table, order, ids, size) of the ids of the words of a stream's texts, each text ended by 0. Ids are formed once, into a
    table in the shared folder, as offsets and windows read it several times; passes over sizes read no ids."""
    words, order = source_words(spark, sf_dir, name)
    ids = F.transform("w", lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    ended = words.select(order, F.concat(ids, F.array(F.lit(0).cast("long"))).alias("ids"), (F.size("w") + 1).cast("long").alias("n"))
    path = files.folder(spark) + f"/{name}"
    ended.write.parquet(path)
    return spark.read.schema(ended.schema).parquet(path), order, "ids", "n"


def web_windows(sizes) -> int:
    """Whole windows of the first stream, of a column of its texts' sizes."""
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // LENGTH


def written(rows, spark, each: int = FILE):
    """(seq, ids) as they are read back from the files that rows(seq, ids) went to, and the report of these files."""
    path = files.folder(spark) + "/stream"
    report = files.write_ids(rows, "seq", "ids", path, each)
    ranges.register(spark)
    back = spark.read.format("packed_ids").option("path", path).option("length", LENGTH).option("suffix", ".u32").load()
    number = F.regexp_extract("path", r"(\d+)\.u32$", 1).cast("long") * each
    return back.select((number + F.col("place")).alias("seq"), "ids"), report


def digest(ids: str = "ids"):
    return F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), " "), 256)


@query(f"""WITH {MIXED},
s AS (SELECT unnest(range(0, (SELECT n FROM n))) AS seq), k AS (SELECT seq, seq % 16 AS r, seq // 16 AS q, CASE WHEN seq % 16 = 14 THEN 'choice' WHEN seq % 4 = 3 THEN 'chat' ELSE 'web' END AS source FROM s),
x AS (SELECT seq, source, CASE source WHEN 'choice' THEN q WHEN 'chat' THEN q * 4 + r // 4 ELSE q * 11 + r - r // 4 + (SELECT monitor FROM n) END AS source_seq FROM k),
p AS (SELECT seq, source, source_seq, i, source_seq * {LENGTH} + i AS pos FROM x, range(0, {LENGTH}) t(i)),
f AS (SELECT p.*, w.id FROM p JOIN w USING (pos) WHERE source = 'web' UNION ALL SELECT p.*, c.id FROM p JOIN c ON c.pos = p.pos % (SELECT count(*) FROM c) WHERE source = 'chat' UNION ALL SELECT p.*, b.id FROM p JOIN b ON b.pos = p.pos % (SELECT count(*) FROM b) WHERE source = 'choice'),
o AS (SELECT 'monitor' AS part, pos // {LENGTH} AS seq, 'web' AS source, pos // {LENGTH} AS source_seq, pos % {LENGTH} AS i, id FROM w WHERE pos < (SELECT monitor FROM n) * {LENGTH} UNION ALL SELECT 'train', seq, source, source_seq, i, id FROM f)
SELECT part, seq, source, source_seq, sha256(string_agg(id::VARCHAR, ' ' ORDER BY i)) AS digest FROM o GROUP BY ALL""")
def mixed_stream(spark, sf_dir):
    """A stream of 64-id sequences mixed of three tables, after a part of the first that is split off for monitoring: choices at
    14 of every 16, chat at 3 of every 4, both beginning again after their end; digests of the ids read back from the files."""
    own = {name: stream(spark, sf_dir, name) for name in PLACES}
    whole = web_windows(own["web"][0])
    monitor = whole // 50
    n = (whole - monitor) // len(PLACES["web"]) * 16
    train = packing.mixed(own, PLACES, 16, LENGTH, n, {"web": monitor}, {"chat", "choice"})
    kept = packing.windows(*own["web"][:3], LENGTH, 0, monitor, size="n").select(F.col("k").alias("seq"), "ids")
    back, _ = written(train.select("seq", "ids"), spark)
    apart, _ = written(kept, spark)
    seq, taken = F.col("seq"), {14: "choice"} | {p: "chat" for p in PLACES["chat"]}
    source = packing.slot_source(seq, 16, taken, "web")
    index = F.when(F.col("source") == "choice", packing.slot_index(seq, 16, PLACES["choice"])).when(F.col("source") == "chat", packing.slot_index(seq, 16, PLACES["chat"])).otherwise(packing.slot_index(seq, 16, PLACES["web"]) + monitor)
    rows = back.withColumn("source", source).select(F.lit("train").alias("part"), "seq", "source", index.cast("long").alias("source_seq"), digest().alias("digest"))
    return rows.unionAll(apart.select(F.lit("monitor"), "seq", F.lit("web"), "seq", digest()))


@query(f"""WITH {MIXED}, h AS (SELECT n // 16 AS q, monitor FROM n),
s AS (SELECT unnest(range(0, (SELECT q FROM h) // 2 * 4)) AS k), p AS (SELECT k // 4 * 16 + k % 4 * 4 + 3 AS seq, k + 7 AS source_seq, i, (k + 7) * {LENGTH} + i AS pos FROM s, range(0, {LENGTH}) t(i)),
f AS (SELECT seq, source_seq, i, id FROM p JOIN c ON c.pos = p.pos % (SELECT count(*) FROM c))
SELECT seq, source_seq, sha256(string_agg(id::VARCHAR, ' ' ORDER BY i)) AS digest, (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM f GROUP BY seq)) * 4 AS all_bytes FROM f GROUP BY 1, 2""")
def continued_mixture(spark, sf_dir):
    """Chat sequences of half a mixture, continued from the seventh window of their stream; and the bytes of its files."""
    own = {"chat": stream(spark, sf_dir, "chat")}
    whole = web_windows(source_words(spark, sf_dir, "web")[0].select((F.size("w") + 1).cast("long").alias("n")))
    n = (whole - whole // 50) // len(PLACES["web"]) // 2 * 16
    found = packing.mixed({"chat": own["chat"]}, {"chat": PLACES["chat"], "none": [p for p in range(16) if p not in PLACES["chat"]]}, 16, LENGTH, n, {"chat": 7}, {"chat"})
    k = packing.slot_index(F.col("seq"), 16, PLACES["chat"])
    back, report = written(found.select(k.cast("long").alias("seq"), "ids"), spark, 100)
    size = F.broadcast(report.agg((F.sum("n") * 4 * LENGTH).alias("all_bytes")))  # an aggregate without keys: one row
    rows = back.select(packing.slot_sequence(F.col("seq"), 16, PLACES["chat"]).cast("long").alias("place"), (F.col("seq") + 7).alias("source_seq"), digest().alias("digest"))
    return rows.crossJoin(size).select(F.col("place").alias("seq"), "source_seq", "digest", "all_bytes")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT *, list_sum(list_transform(e, lambda x: abs(x))) / 64 AS scale FROM e),
c AS (SELECT vec_id, scale, list_transform(e, lambda x: greatest(least(round_even(x / scale, 0), 1), -1)::INTEGER) AS c FROM s)
SELECT vec_id, round(scale, 6) AS scale, len(list_filter(c, lambda x: x = 0))::INTEGER AS zeros, list_sum(c)::BIGINT AS total, array_to_string(list_transform(range(0, 16), lambda i: lower(printf('%02x', (c[i*4+1]+1) + 4*(c[i*4+2]+1) + 16*(c[i*4+3]+1) + 64*(c[i*4+4]+1)))), '') AS packed, true AS same FROM c""")
def ternary_codes(spark, sf_dir):
    """Vectors to ternary groups by their mean magnitude, packed to 2-bit codes, and read back the same."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    scale, found = codes.absmean("e")
    c = e.select("vec_id", scale.alias("scale"), found.alias("c")).withColumn("packed", codes.packed("c"))
    return c.select("vec_id", F.round("scale", 6).alias("scale"), F.size(F.filter("c", lambda x: x == 0)).alias("zeros"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), "packed", (codes.unpacked("packed") == F.col("c")).alias("same"))


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, source FROM r JOIN n USING (source) WHERE n >= 3 AND i IN (0, (n - 1) // 2, n - 1)""")
def evenly_spaced(spark, sf_dir):
    """Three evenly spaced rows of each source, by i * (n - 1) div 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    r = packing.offsets(docs.withColumn("one", F.lit(1)), "doc_id", "one", by=("source",)).withColumnRenamed("start", "i")
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return r.join(n, "source").where("i IN (0, (n - 1) div 2, n - 1)").select("doc_id", "source")
