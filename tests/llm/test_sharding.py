import random
import zlib
from collections import Counter

from rubrica.llm import sharding


def test_first_map_is_even_and_gapless():
    rng = random.Random(1)
    sums = [rng.randint(0, 1000) for _ in range(4096)]
    totals = Counter()
    for slot, shard in enumerate(sharding.first_map(sums)):
        totals[shard] += sums[slot]
    assert set(totals) == set(range(8)) and max(totals.values()) - min(totals.values()) <= 1000


def test_rebalancing_moves_few_slots():
    rng = random.Random(2)
    sums = [rng.randint(1, 1000) for _ in range(4096)]
    placed = sharding.first_map(sums)
    for shards in (8, 9, 7):
        grown = [s + (500 if p == 0 else 0) for s, p in zip(sums, placed)]
        edited = sharding.rebalanced(placed, grown, shards)
        totals = Counter()
        for slot, shard in enumerate(edited):
            totals[shard] += grown[slot]
        share = sum(grown) / shards
        assert set(totals) == set(range(shards)) and max(totals.values()) <= share * 1.02
        moved = sum(a != b for a, b in zip(placed, edited))
        assert moved < len(placed) / 3
    assert sharding.rebalanced(placed, sums) == placed


def test_rows_and_versions(spark, awkward, nothing, tables, tmp_path):
    folder = tables(documents=awkward)
    rows = sharding.op8_sharding(spark, folder).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in awkward.collect()}
    places = {}
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert r.law == "bytes" and r.grown_shard is None
        places.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == awkward.count()
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    size = sharding.size_of(awkward.text)
    sums, _ = sharding.slot_totals(awkward, size)
    placed = sharding.first_map(sums)
    sharding.store_map(spark, placed, sums, f"{tmp_path}/map", 1)
    assert sharding.rebalance(spark, awkward, f"{tmp_path}/map", 3) == 2
    assert sharding.load_map(spark, f"{tmp_path}/map", 1)[1] == placed
    assert set(sharding.load_map(spark, f"{tmp_path}/map")[1]) == {0, 1, 2}
    sharding.write_shards(awkward, placed, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == awkward.count() and set(awkward.columns) < set(back.columns)
    assert sharding.slot_totals(nothing, sharding.size_of(nothing.text))[0] == [0] * sharding.SLOTS


def test_the_query_assigns_from_the_stored_map(spark, awkward, tables, tmp_path, monkeypatch):
    folder = f"{tmp_path}/map"
    monkeypatch.setattr(sharding, "fresh_path", lambda session, label: folder, raising=False)
    rows = sharding.op8_sharding(spark, tables(documents=awkward)).collect()
    version, placed, sums = sharding.load_map(spark, folder)
    assert version == 1 and len(placed) == sharding.SLOTS and sum(sums) == sum(r["size"] for r in rows)
    assert all((r.map_version, r.shard) == (version, placed[r.virtual_slot]) for r in rows)
    assert sharding.rebalance(spark, awkward, folder, 3) == 2
