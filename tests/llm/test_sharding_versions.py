from collections import defaultdict

import pytest

from tersa.llm import sharding


def placed(docs, shards, path):
    rows = sharding.shard(docs, shards, 64, path).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return {r.doc_id: r.shard for r in rows}, len(rows)


def test_an_existing_map_is_edited(spark, tmp_path, docs_of):
    path = f"file://{tmp_path}/map"
    versions = lambda: sorted((r.version, r.n) for r in spark.read.parquet(path).groupBy("version").agg({"*": "count"}).toDF("version", "n").collect())
    rows = [(i, "x" * (i % 50)) for i in range(300)]
    first, n = placed(docs_of(rows), 3, path)
    assert placed(docs_of(rows), 3, path) == (first, n) and n == 300 and versions() == [(1, 64)]
    grown, n = placed(docs_of(rows), 4, path)
    assert n == 300 and versions() == [(1, 64), (2, 64)]
    assert all(grown[d] in (first[d], 3) for d in first) and 3 in grown.values()
    more, n = placed(docs_of(rows + [(1000 + i, "y") for i in range(50)]), 4, path)
    assert n == 350 and {d: more[d] for d in grown} == grown and versions()[-1] == (3, 64)
    with pytest.raises(ValueError, match="4 shards"):
        sharding.shard(docs_of(rows), 3, 64, path)
