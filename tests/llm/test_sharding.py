import random
import zlib
from collections import defaultdict

from loreloom.llm import sharding
from tests.llm.helpers import documents


def test_shards_are_contiguous_and_near_equal(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(10**6), "é" * rng.randrange(300)) for _ in range(3000)]
    rows += [(None, None), (None, "x"), (-5, None), (7, "same"), (7, "same"), (7, "same"), (8, ""), (9, "y" * 20_000)]
    got = sharding.shards(documents(spark, rows).repartition(6), 40).collect()
    assert len(got) == len(rows)
    size, by_shard = defaultdict(int), defaultdict(list)
    for r in got:
        size[r.shard] += r["size"]
        by_shard[r.shard].append(r)
        assert (r.law, r.grown_shard) == ("bytes", None)
    share, longest = sum(size.values()) / 40, max(r["size"] for r in got)
    assert set(size) <= set(range(40)) and all(abs(s - share) <= longest for s in size.values())
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    for s in range(39):
        if by_shard[s] and by_shard[s + 1]:
            assert max(map(key, by_shard[s])) <= min(map(key, by_shard[s + 1]))
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert [r.slot for r in sorted(members, key=lambda r: (*key(r), r.text_crc32, r["size"]))] == list(range(len(members)))
    expected = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == expected


def test_fewer_rows_than_shards(spark):
    got = sharding.shards(documents(spark, [(1, "a"), (2, "b")]), 40).collect()
    assert len({r.shard for r in got}) == 2 and {r.slot for r in got} == {0}
    assert sharding.shards(documents(spark, []), 40).count() == 0
