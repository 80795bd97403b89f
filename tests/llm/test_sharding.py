from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tracewell.llm import common
from tracewell.llm.sharding import external_shuffle, fisher_yates, write_shards


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(fisher_yates(3, np.random.default_rng(i))) for i in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
    assert fisher_yates(0, np.random.default_rng(0)).tolist() == []


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_permutation_of_all_rows(spark):
    rows = [(i, f"text {i % 50} " * (i % 7), None if i % 9 == 0 else "s", i) for i in range(2000)]
    rows += [(None, None, None, None), (5, "", "s", 1), (7, "w " * 200_000, "s", 2), (3, "same", "s", 3), (3, "same", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard string, position long")
    got = external_shuffle(docs, bucket_bytes=20_000)
    assert got.columns == [*docs.columns, "shard_1", "position_1"]
    out = got.collect()
    assert Counter(tuple(r)[:4] for r in out) == Counter(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard_1, []).append(r.position_1)
    assert len(by) > 10
    assert all(sorted(p) == list(range(len(p))) for p in by.values())
    assert rows_of(external_shuffle(docs, bucket_bytes=20_000)) == rows_of(got)
    assert rows_of(external_shuffle(docs, seed=18, bucket_bytes=20_000)) != rows_of(got)


M64 = (1 << 64) - 1


def finish(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def test_order_recomputed(spark):
    """The whole result from the hashes of the rows, with plain whole numbers and swaps."""
    docs = spark.createDataFrame([(i % 90, f"t{i % 90}", {"a": i % 90}) for i in range(400)], "doc_id long, text string, more map<string, int>").repartition(3).cache()
    docs.count()
    by_hash = F.xxhash64(F.lit(17), "doc_id", "text", F.to_json(F.struct(F.col("more").alias("c"))))
    buckets, seen = {}, Counter()
    total = common.total_bytes(docs)[1]
    n = -(-total // 3000)
    assert n > 3
    for r in docs.select("doc_id", by_hash.alias("h"), F.spark_partition_id().alias("p")).collect():
        number = seen[r.p, r.h]
        seen[r.p, r.h] += 1
        own = finish((r.h & M64) ^ finish((number * 0x9E3779B97F4A7C15 + r.p + 1) & M64))
        buckets.setdefault(finish((own + 1) & M64) % n, []).append((own - (1 << 64) if own >> 63 else own, r.doc_id))
    want = []
    for b, rows in buckets.items():
        order = [d for _, d in sorted(rows)]
        draws = np.random.default_rng([17, b]).random(len(order))
        for i in range(len(order) - 1, 0, -1):
            j = int(draws[i] * (i + 1))
            order[i], order[j] = order[j], order[i]
        want += [(b, i, d) for i, d in enumerate(order)]
    got = [(r.shard, r.position, r.doc_id) for r in external_shuffle(docs, bucket_bytes=3000).collect()]
    assert sorted(got) == sorted(want)


def test_equal_rows_spread(spark):
    docs = spark.range(20_000).selectExpr("1L as doc_id", "'the same text' as text").repartition(3)
    sizes = Counter(r.shard for r in external_shuffle(docs, bucket_bytes=100_000).collect())
    assert len(sizes) > 5 and max(sizes.values()) < 1.2 * min(sizes.values())


def test_written_shards(spark, tmp_path):
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('x', 50) as text")
    write_shards(docs, f"{tmp_path}/out", bucket_bytes=20_000)
    want = {}
    for r in sorted(external_shuffle(docs, bucket_bytes=20_000).collect(), key=lambda r: (r.shard, r.position)):
        want.setdefault(r.shard, []).append(r.doc_id)
    got = {int(f.parent.name[6:]): pq.read_table(f)["doc_id"].to_pylist() for f in (tmp_path / "out").glob("shard=*/*.parquet")}
    assert got == want and len(got) > 3


def test_order_is_uniform(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    out = external_shuffle(docs, bucket_bytes=20_000).orderBy("shard", "position").collect()
    ids = np.array([r.doc_id for r in out])
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.06
    sizes = np.array(list(Counter(r.shard for r in out).values()))
    assert sizes.max() < 1.6 * sizes.mean()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert external_shuffle(docs).count() == 0
