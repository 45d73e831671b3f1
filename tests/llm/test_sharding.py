import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wavegrid.llm import storage
from wavegrid.llm.sharding import Conflict, Shard, ShardStore, in_order, op5_size_tiered_sharding, shard_documents

from .conftest import SCHEMA


def plain(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def test_rows_survive(spark, docs, rows, tmp_path):
    store = shard_documents(docs.withColumn("shard", docs.lang), f"file://{tmp_path}/s", small=2000, target=9000, fan_in=2, arrivals=3)
    version, shards = store.manifest()
    out = store.read(docs.schema)
    assert plain(out) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert sum(s.rows for s in shards) == len(rows) and len({s.number for s in shards}) == len(shards)
    assert not store.plan(shards) and version > 3
    assert out.where("shard_rows is null").count() == 0
    where, folder = storage.located(f"{tmp_path}/s/data")
    assert {f.base_name for f in where.get_file_info(storage.fs.FileSelector(folder))} == {s.name.rpartition("/")[2] for s in shards}


def test_versions_and_conflicts(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", small=1 << 20, fan_in=2)
    a = spark.createDataFrame([(1, "a", None, None, None)], SCHEMA)
    assert store.manifest() == (0, []) and store.read(a.schema).count() == 0
    assert store.append(spark.createDataFrame([], SCHEMA)) == 0
    first = store.append(a)
    second = store.append(a)
    assert plain(store.read(a.schema, first)) == plain(a) and store.read(a.schema, second).count() == 2
    with pytest.raises(Conflict):
        store.commit(first, [])
    third = store.compact()
    assert third == second + 1 and len(store.manifest()[1]) == 1 and len(store.manifest(second)[1]) == 2
    assert store.compact() == third
    assert store.vacuum() == 2 and store.read(a.schema).count() == 2


def test_plan_by_tiers(spark):
    store = ShardStore(spark, "file:///nowhere", small=10, target=100, fan_in=4)
    assert [store.tier(n) for n in (0, 10, 11, 40, 41, 160)] == [0, 0, 1, 1, 2, 2]
    shards = [Shard(f"s{k}", 10, 1, k) for k in range(11)] + [Shard("big", 100, 5, 11), Shard("middle", 41, 5, 12)]
    groups = store.plan(shards)
    assert sorted(len(g) for g in groups) == [4, 4]
    assert not {"big", "middle"} & {s.name for g in groups for s in g}
    many = store.plan([Shard(f"s{k}", 10, 1, k) for k in range(64)])
    sizes = sorted(sum(s.bytes for s in g) for g in many)
    assert sum(sizes) == 640 and all(100 <= n <= 160 for n in sizes[1:])  # what is left over waits for more


def test_clashing_names(spark, docs, rows, tmp_path):
    """The user's columns stay, whatever they are called; only those named like a result are replaced."""
    extra = docs.withColumn("shard_name", docs.lang).withColumn("wg_shard", docs.source).withColumn("Shard_Number", docs.text)
    out = shard_documents(extra, f"file://{tmp_path}/s", small=2000, target=9000, fan_in=2).read(extra.schema)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and {"shard_name", "wg_shard"} <= set(out.columns)
    assert sorted((str(r.doc_id), str(r.shard_name), str(r.wg_shard)) for r in out.collect()) == sorted((str(r[0]), str(r[2]), str(r[3])) for r in rows)
    assert out.where("shard_number is null").count() == 0


def test_shards_are_sorted(spark, docs, rows, tmp_path):
    store = shard_documents(docs, f"file://{tmp_path}/s", small=1500, target=30000, fan_in=2, arrivals=2)
    _, shards = store.manifest()
    merged = 0
    for s in shards:
        ids = pq.read_table(s.name).column("doc_id").to_pylist()
        assert len(ids) == s.rows and ids == sorted(ids, key=lambda d: (d is None, d or 0))
        merged += "/m-" in s.name
    assert merged


def test_parts_side_by_side():
    r = random.Random(3)
    for _ in range(30):
        parts = [sorted((r.choice([None, r.randrange(50)]) for _ in range(r.randrange(40))), key=lambda d: (d is None, d or 0)) for _ in range(r.randrange(1, 6))]
        tables = [pa.table({"k": pa.array(p, pa.int64()), "v": pa.array([str(x) for x in p])}) for p in parts]
        out = [t for t in in_order([iter(t.to_batches(max_chunksize=r.randrange(1, 9))) for t in tables], "k")]
        keys = [k for t in out for k in t.column("k").to_pylist()]
        assert keys == sorted((k for p in parts for k in p), key=lambda d: (d is None, d or 0))
        assert [v for t in out for v in t.column("v").to_pylist()] == [str(k) for k in keys]


def test_the_query(spark, rows, tmp_path):
    """Its own columns: every row once, and shards that have as many rows as they say."""
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = op5_size_tiered_sharding(spark, str(tmp_path)).collect()
    want = [(str(d), str(None if t is None else len(t.encode())), str(None if t is None else hashlib.sha256(t.encode()).hexdigest())) for d, t, *_ in rows]
    assert sorted(want) == sorted((str(r.doc_id), str(r.n_bytes), str(r.text_sha256)) for r in out)
    sizes = {}
    for r in out:
        sizes[r.shard_number] = sizes.get(r.shard_number, 0) + 1
    assert all(sizes[r.shard_number] == r.shard_rows for r in out)
