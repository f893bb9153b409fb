"""Files written and read again: what comes back is what the tables hold."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import functions as F

from tessella.functions.stats import mean_interval
from tessella.sources import files, ranges, scores, tensors
from tessella.plans.registry import query, table


@query("SELECT c_custkey AS id, c_mktsegment AS kind, c_acctbal AS score FROM customer")
def jsonl_with_fallback(spark, sf_dir):
    """Written as JSON lines where nothing was, replaced, and read by the second of two paths."""
    path = files.folder(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("score"))
    files.write_new(rows.limit(1), f"{path}/plain")
    files.replace(rows, f"{path}/plain")
    return files.jsonl(spark, "id LONG, kind STRING, score DOUBLE", f"{path}/with-logprobs", f"{path}/plain")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    path = files.folder(spark)
    files.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), f"{path}/csv")
    return files.csv(spark, f"{path}/csv", "s_suppkey LONG, s_name STRING, s_acctbal DOUBLE")


@query("SELECT l_orderkey::VARCHAR AS id, 'nll' AS kind, sum(l_partkey)::BIGINT AS ids_sum, count(*) AS n_ids FROM lineitem GROUP BY 1")
def case_files(spark, sf_dir):
    """Token cases written tab-separated and read again; the digest of what was written is the same when written twice."""
    path = files.folder(spark)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.sort_array(F.collect_list(F.col("l_partkey").cast("int"))).alias("ids"))
    rows = rows.select("id", F.lit("nll").alias("kind"), "ids", F.lit(None).cast("string").alias("arg"))
    files.write_cases(rows, f"{path}/cases")
    found = scores.cases(spark, f"{path}/cases")
    return found.select("id", "kind", F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("ids_sum"), F.size("ids").cast("long").alias("n_ids"))


@query("""WITH s AS (SELECT c_nationkey AS seq, list(c_custkey ORDER BY c_custkey) AS ids FROM customer GROUP BY 1), k AS (SELECT unnest(range(0, 40)) AS place)
SELECT place::INTEGER AS "at", seq, list_sum(ids)::BIGINT AS ids_sum, 4 * len(ids) AS n_bytes FROM k JOIN s ON seq = (place + 20) % 25""")
def wrapped_batch(spark, sf_dir):
    """A batch of packed 32-bit sequences that begins again after the last of 25."""
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("seq")).agg(files.pack_ids(F.sort_array(F.collect_list("c_custkey"))).alias("data"))
    batch = files.wrapped(s, "seq", 25, 20, 40).withColumn("ids", files.unpack_ids("data"))
    return batch.select("at", "seq", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids_sum"), F.octet_length("data").cast("long").alias("n_bytes"))


@query("SELECT n_regionkey::VARCHAR AS subject, n_nationkey, n_name FROM nation")
def arrow_subjects(spark, sf_dir):
    """Arrow streams, one file for each subject."""
    path = files.folder(spark)
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("subject"), "n_nationkey", "n_name")

    def stream(group: pa.Table) -> pa.Table:
        out = io.BytesIO()
        part = group.drop_columns("subject")
        with pa.ipc.new_stream(out, part.schema) as w:
            w.write_table(part)
        return pa.table({"subject": group.column("subject")[:1], "content": pa.array([out.getvalue()], pa.binary())})

    whole = rows.groupBy("subject").applyInArrow(stream, "subject string, content binary")
    _write_files(whole, "subject", f"{path}/subjects", ".arrow")
    return files.arrow_streams(spark, f"{path}/subjects", "n_nationkey int, n_name string")


def _write_files(rows, name: str, path: str, suffix: str) -> None:
    """A file for each row of rows(name, content), written by the executors."""
    from pyarrow import fs

    def run(parts):
        for part in parts:
            for n, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                store, base = fs.FileSystem.from_uri(path)
                store.create_dir(base, recursive=True)
                with store.open_output_stream(f"{base}/{n}{suffix}") as f:
                    f.write(content)
            yield part.select([name])

    rows.select(name, "content").mapInArrow(run, f"{name} string").write.format("noop").mode("overwrite").save()


@query("""WITH g AS (SELECT p_brand AS shard, p_partkey, p_size::BIGINT AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part)
SELECT shard, 'tensor.' || p_partkey AS tensor, 'F16' AS dtype, size, (coalesce(sum(2 * size) OVER (PARTITION BY shard ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM g""")
def tensor_headers(spark, sf_dir):
    """Headers of tensor shards: names, types, shapes and offsets."""
    path = files.folder(spark)
    listed = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("shard")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))).alias("t"))

    @F.pandas_udf("binary")
    def header(t):
        import json

        def one(tensors):
            at, head = 0, {"__metadata__": {"format": "pt"}}
            for x in tensors:
                head[f"tensor.{x['p_partkey']}"] = {"dtype": "F16", "shape": [int(x["p_size"])], "data_offsets": [at, at + 2 * int(x["p_size"])]}
                at += 2 * int(x["p_size"])
            data = json.dumps(head).encode()
            return len(data).to_bytes(8, "little") + data + bytes(at)

        return t.map(one)

    _write_files(listed.select("shard", header("t").alias("content")), "shard", f"{path}/shards", "")
    ranges.register(spark)
    found = spark.read.format("shard_headers").option("path", f"{path}/shards").load()
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("shard"), "tensor", "dtype", F.element_at("shape", 1).alias("size"), "start")


@query("""WITH b AS (SELECT p_brand, count(*) AS n, list(p_partkey ORDER BY p_partkey) AS keys, sum(p_size) AS size FROM part GROUP BY 1)
SELECT p_brand || '.gguf' AS file, 'part.count' AS key, n::VARCHAR AS value FROM b UNION ALL SELECT p_brand || '.gguf', 'part.keys', '[' || array_to_string(keys, ', ') || ']' FROM b""")
def container_metadata(spark, sf_dir):
    """Two of the metadata pairs of containers, one for each brand; the filter reaches the header's reader, which skips others."""
    path = files.folder(spark)
    listed = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("shard")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))).alias("t"))

    @F.pandas_udf("binary")
    def header(t):
        def one(rows):
            keys = [int(x["p_partkey"]) for x in rows]
            pairs = {"general.name": (tensors.STRING, "parts"), "part.names": (tensors.ARRAY, (tensors.STRING, [f"part {k}" for k in keys])), "part.count": (4, len(keys)), "part.keys": (tensors.ARRAY, (11, keys)), "part.mean": (12, sum(keys) / len(keys))}
            return tensors.container(pairs, [(f"tensor.{k}", 0, [1], 4 * i) for i, k in enumerate(keys)])

        return t.map(one)

    _write_files(listed.select("shard", header("t").alias("content")), "shard", f"{path}/containers", ".gguf")
    ranges.register(spark)
    found = spark.read.format("container_metadata").option("path", f"{path}/containers").load().where("key IN ('part.count', 'part.keys')")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "key", "value")


@query("SELECT v.vec_id % 7 || '.bin' AS file, v.vec_id, round(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings v")
def logit_files(spark, sf_dir):
    """Rows of binary files with a header and a fixed stride; the first value is the row's number."""
    path = files.folder(spark)
    width = F.size("embedding")
    rows = table(spark, sf_dir, "embeddings").select(F.concat((F.col("vec_id") % 7).cast("string"), F.lit(".bin")).alias("file"), "vec_id", "embedding")
    n = rows.select(width.alias("n")).first().n

    def binary(group: pa.Table) -> pa.Table:
        import struct

        import numpy as np

        ids, values = group.column("vec_id").to_numpy(), np.array(group.column("embedding").to_pylist(), "<f4")
        data = np.concatenate([ids[:, None].astype("<f4"), values], 1).astype("<f4")
        return pa.table({"file": group.column("file")[:1], "content": pa.array([struct.pack("<ii", *data.shape) + data.tobytes()], pa.binary())})

    _write_files(rows.groupBy("file").applyInArrow(binary, "file string, content binary"), "file", f"{path}/logits", "")
    found = files.logit_rows(spark, f"{path}/logits", n + 1)
    total = F.aggregate(F.slice("values", 2, n), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("file", F.element_at("values", 1).cast("long").alias("vec_id"), F.round(total, 4).alias("total"))


@query("""WITH n AS (SELECT r_name || '.json' AS file, [x.n_nationkey FOR x IN list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey)] AS ids, lower(string_agg(replace(n_name, '_', ' '), ' ' ORDER BY n_name)) AS words FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT file, array_to_string(ids, ',') AS ids FROM n""")
def file_inventory(spark, sf_dir):
    """Numbers that JSON files of nested objects mention, from all files below a folder."""
    path = files.folder(spark)
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    rows = nations.groupBy(F.col("r_name").alias("file")).agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows")).alias("deep"))).cast("binary").alias("content"))
    _write_files(rows, "file", f"{path}/deep/er", ".json")
    found = files.inventory(spark, path)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(r"""WITH m AS (SELECT c_mktsegment AS s, '| ' || c_mktsegment || ' | ' || printf('%.2f [%.2f, %.2f]', avg(c_acctbal), avg(c_acctbal) - 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), avg(c_acctbal) + 1.96 * stddev_samp(c_acctbal) / sqrt(count(*))) || ' |' AS line FROM customer GROUP BY 1)
SELECT row_number() OVER (ORDER BY s) + 1 AS place, line FROM m UNION ALL SELECT 0, '| segment | balance |' UNION ALL SELECT 1, '| --- | --- |'""")
def report_cells(spark, sf_dir):
    """The lines of a Markdown table with means and intervals."""
    mean, low, high = mean_interval(F.col("c_acctbal"))
    found = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(mean.alias("mean"), low.alias("low"), high.alias("high"))
    return files.markdown(found, {"segment": F.col("c_mktsegment"), "balance": files.interval_cell(F.col("mean"), F.col("low"), F.col("high"))}, "c_mktsegment")
