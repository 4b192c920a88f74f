"""The hash ring against a key-by-key simulation, and how many keys move when a shard is added."""

import numpy as np

from tideline.llm import hash_ring, storage


def documents(spark, n):
    return spark.createDataFrame([(i, f"text {i % 37}" * (i % 5)) for i in range(n)], "doc_id bigint, text string")


def test_keys_go_where_a_simulation_puts_them(spark):
    docs, shards = documents(spark, 300), 5
    rows = hash_ring.assign_shards(docs, shards, points=8, cell_rows=20).collect()
    at, owners = hash_ring.ring(shards, 8)
    keyed = spark.createDataFrame([(r.doc_id, r.text_crc32, r.size) for r in rows], "doc_id bigint, text_crc32 bigint, size bigint")
    place = {r.doc_id: r.pos % 2**64 for r in keyed.selectExpr("doc_id", "xxhash64(doc_id, text_crc32, size) AS pos").collect()}
    arcs = {}
    for doc in sorted(place, key=place.get):
        arcs.setdefault(int(np.searchsorted(at, np.uint64(place[doc]))), []).append(doc)
    room = [300 // shards + (s < 300 % shards) for s in range(shards)]
    walk = {arc: list(dict.fromkeys(int(owners[(arc + k) % len(owners)]) for k in range(len(owners)))) for arc in arcs}
    want = {}
    for hop in range(shards):
        for arc in sorted(arcs):
            while arcs[arc] and room[walk[arc][hop]]:
                want[arcs[arc].pop(0)] = walk[arc][hop]
                room[walk[arc][hop]] -= 1
    assert {r.doc_id: r.shard for r in rows} == want


def test_few_keys_move_when_a_shard_is_added(spark):
    docs = documents(spark, 4000)
    one, two = ({r.doc_id: r.shard for r in hash_ring.assign_shards(docs, n).collect()} for n in (16, 17))
    moved = [d for d in one if one[d] != two[d]]
    assert 1 / 17 - 0.01 <= len(moved) / 4000 < 0.12
    assert sum(two[d] != 16 for d in moved) / 4000 < 0.06


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    try:
        storage.shared_folder(Session())
    except RuntimeError:
        pass
    else:
        raise AssertionError("a machine's own folder was taken")


def test_tables_that_nothing_reads_are_deleted(spark):
    table = storage.materialise(spark.range(5), "gone")
    assert table.count() == 5
    path = table.inputFiles()[0]
    storage.discard(table)
    import os

    assert not os.path.exists(path.removeprefix("file:").replace("///", "/"))
