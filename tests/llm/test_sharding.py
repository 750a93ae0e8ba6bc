import zlib
from collections import defaultdict

from tersa.llm import sharding

from .conftest import EDGES


def test_every_row_has_a_place(edges):
    rows = sharding.shard(edges, shards=3, slots=16).collect()
    assert len(rows) == len(EDGES)
    want = sorted((len((e[1] or "").encode()) + 8, zlib.crc32((e[1] or "").encode())) for e in EDGES)
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_bytes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs, shards=24).collect()
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += r["size"]
    assert len(load) == 24
    assert max(load.values()) <= 1.01 * min(load.values())


def test_growing_moves_rows_only_into_the_new_shard():
    sizes = {v: (1, (v * 7919) % 1000 + 1) for v in range(512)}
    first = sharding.first_map(sizes, 4, 512)
    grown = sharding.grown_map(first, sizes)
    assert all(grown[v] == first[v] or grown[v] == 4 for v in first)
    load = defaultdict(int)
    for v, s in grown.items():
        load[s] += sizes[v][1]
    assert max(load.values()) <= 1.05 * min(load.values())


def test_map_versions_stay_readable(spark, tmp_path, docs_of):
    docs = docs_of([(i, "x" * (i % 50)) for i in range(300)])
    path = f"file://{tmp_path}/map"
    rows = sharding.slotted(docs, 64)
    sizes = sharding.slot_sizes(rows)
    first = sharding.first_map(sizes, 3, 64)
    sharding.save_map(spark, sharding.map_rows(first, sizes, 1), path)
    sharding.save_map(spark, sharding.map_rows(sharding.grown_map(first, sizes), sizes, 2), path)
    old = {r.doc_id: r.shard for r in sharding.placed(rows, sharding.read_map(spark, path, 1)).collect()}
    new = {r.doc_id: r.shard for r in sharding.placed(rows, sharding.read_map(spark, path, 2)).collect()}
    assert len(old) == len(new) == 300
    assert all(new[d] in (old[d], 3) for d in old) and 3 in new.values()
    sharding.write_shards(docs, sharding.read_map(spark, path, 2), f"{path}-out", slots=64)
    assert {r.doc_id: r._shard for r in spark.read.parquet(f"{path}-out").collect()} == new


def test_empty(docs_of):
    assert sharding.shard(docs_of([])).count() == 0
