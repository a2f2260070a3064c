import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnfold.llm import batch_dedup
from cairnfold.llm.batch_dedup import BatchIndex, Ladder, chunk_verdicts, near_duplicates, upload_links

SCHEMA = "scope string, obj long, batch int, element string, cid long, codes string"


def _frame(spark, sets):
    return spark.createDataFrame([(s, o, b, e, 1, "clash") for s, o, b, els in sets for e in els], SCHEMA)


def _sets(seed, n=160):
    r = random.Random(seed)
    hot = [f"h{i}" for i in range(5)]
    sets = []
    for i in range(n):
        if sets and r.random() < 0.5:
            s, _, _, base = r.choice(sets)
            els = [e for e in base if r.random() > r.choice([0, 0.05, 0.1, 0.2])] or base[:1]
            els = els + [f"x{i}_{k}" for k in range(r.choice([0, 0, 1, 2, 4]))]
        else:
            s = r.choice("ab")
            els = [f"e{r.randrange(100000)}" for _ in range(r.choice([1, 2, 3, 6, 12, 30]))] + [h for h in hot if r.random() < 0.6]
        sets.append((s, i, i * 4 // n, sorted(set(els))))
    return sets


def _truth(sets, least=0.7):
    out = set()
    for s, o, b, x in sets:
        for t, p, c, y in sets:
            i = len(set(x) & set(y))
            if s == t and b < c and i >= least * (len(set(x) | set(y))) - 1e-9:
                out.add((o, p))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_pairs_are_found(spark, seed, monkeypatch):
    if seed == 3:  # a low bound makes the five common elements, and some more, frequent ones
        monkeypatch.setattr(batch_dedup, "FREQUENT", 8)
        monkeypatch.setattr(batch_dedup.frequent_elements, "__defaults__", (8,))
    sets = _sets(seed)
    df = _frame(spark, sets + sets[:10])
    got = [(x.obj_a, x.obj_b) for x in near_duplicates(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _truth(sets)


def test_links_count_what_pairs_would(spark):
    sets = _sets(4)
    truth = _truth(sets)
    content = {o: (s, tuple(e)) for s, o, _, e in sets}
    for x in upload_links(_frame(spark, sets)).collect():
        mine = [a for a, b in truth if b == x.obj]
        assert x.links == len(mine)
        assert x.copies == sum(1 for a in mine if content[a] == content[x.obj])
        assert x.class_id == min(o for o, c in content.items() if c == content[x.obj])


def test_a_large_group_of_copies(spark):
    sets = [("a", i, 0 if i < 100 else 1, ["p", "q", "r", "s"]) for i in range(120)]
    assert near_duplicates(_frame(spark, sets)).count() == 100 * 20


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, 0, "x", 1, ""), ("a", None, 1, "x", 1, ""), ("a", 2, 1, None, 1, ""), ("a", 3, 0, "x", 1, ""), ("a", 4, 1, "x", 1, "")], SCHEMA)
    assert {(x.obj_a, x.obj_b) for x in near_duplicates(df).collect()} == {(3, 4)}
    assert near_duplicates(df.limit(0)).count() == 0
    assert upload_links(df.limit(0)).count() == 0


def test_batch_by_batch_gives_the_same(spark, tmp_path):
    sets = _sets(6, 100)
    index = BatchIndex(spark, str(tmp_path / "index"))
    index.append(_frame(spark, [x for x in sets if x[2] == 0]))
    got = set()
    for b in (1, 2, 3):
        batch = _frame(spark, [x for x in sets if x[2] == b])
        got |= {(x.obj_a, x.obj_b) for x in index.check(batch).collect()}
        index.append(batch)
    assert got == _truth(sets)


def test_deliveries_of_any_size_give_the_same(spark):
    sets = _sets(8, 120)
    for at_once in (1, 2):
        assert {(x.obj_a, x.obj_b) for x in near_duplicates(_frame(spark, sets), at_once=at_once).collect()} == _truth(sets)


def test_history_is_not_shuffled_and_opens_again(spark, tmp_path):
    sets = _sets(9, 100)
    folder = str(tmp_path / "index")
    index = BatchIndex(spark, folder, buckets=3)
    index.append(_frame(spark, [x for x in sets if x[2] < 3]))
    for name in ("blocks", "sets", "members"):
        spark.sql(f"DROP TABLE {index._name(name)}")  # another session knows the folder only
    index = BatchIndex(spark, folder)
    batch = _frame(spark, [x for x in sets if x[2] == 3])
    assert {(x.obj_a, x.obj_b) for x in index.check(batch).collect()} == {p for p in _truth(sets) if sets[p[1]][2] == 3}
    width = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = batch_dedup.classes(batch_dedup.members(batch))
        looked = batch_dedup.signatures(table, index._frequent(), "last", True)
        plan = batch_dedup.candidate_pairs(index.table("blocks"), looked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", width)
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("Exchange hashpartitioning(key") == 1  # the batch only
    assert "Bucketed: true" in join


def test_full_buckets_and_classes_are_dealt(spark):
    sets = _sets(10, 120) + [("a", 1000 + i, i % 3, ["p", "q", "r", "s"]) for i in range(30)]
    index_sets = batch_dedup.members(_frame(spark, sets)).cache()
    links, index = batch_dedup.deliver(index_sets)
    own = index.table("members")
    got = batch_dedup.expand(links, own, own.where("batch > 0"), heavy_share=0.01)
    assert {(x.obj_a, x.obj_b) for x in got.collect()} == _truth(sets)
    table = batch_dedup.classes(index_sets)
    assert index.links(table, heavy_share=0.001).select("a2", "b2").distinct().count() == index.links(table).select("a2", "b2").distinct().count()


def test_elements_with_one_code_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(batch_dedup.F, "xxhash64", lambda *c: F.abs(F.crc32(F.concat_ws("", *c).cast("binary")) % 7).cast("bigint"))
    sets = [("a", 1, 0, list("abcdefgh")), ("a", 2, 1, list("ijklmnop")), ("a", 3, 1, list("abcdefgh"))]
    assert {(x.obj_a, x.obj_b) for x in near_duplicates(_frame(spark, sets)).collect()} == {(1, 3)}


def test_sizes_of_similar_sets_share_the_blocks():
    ladder = Ladder(0.7)
    upper = ladder.upper(500)
    blocks = ladder.blocks(upper)
    for n in range(1, 300):
        m = int(n / 0.7 + 1e-9)
        k = next(i for i, u in enumerate(upper) if n <= u)
        assert blocks[k] > ladder.differences(n, m)


def test_chunk_verdicts(spark):
    r = random.Random(7)
    fps = [f"F{i}" for i in range(40)]
    hist = [(r.choice(["a", "b", None]), r.choice([*fps[:15], None])) for _ in range(60)]
    index = [(r.choice("ab"), r.choice(fps).lower(), r.choice([None, 1, 2, 3])) for _ in range(60)]
    chunks = [(i, r.choice(["a", "b", None]), fps[0] if r.random() < 0.4 else r.choice([*fps, None])) for i in range(300)]
    h = spark.createDataFrame([(*x, "c") for x in hist], "namespace string, fp string, key string")
    x = spark.createDataFrame([(*y, 1) for y in index], "namespace string, fp string, dcid long, n int")
    c = spark.createDataFrame([(*y, 9, False) for y in chunks + chunks[:30]], "chunk_id long, namespace string, fp string, dcid long, deduped boolean")
    got = {v.chunk_id: (v.deduped, v.dcid) for v in chunk_verdicts(c, h, x).collect()}
    known = {(n, f.lower()) for n, f in hist if n and f}
    at, seen, want = {}, set(), {}
    for n, f, d in index:
        if d is not None:
            at[n, f] = min(d, at.get((n, f), d))
    for i, n, f in chunks:
        k = (n, f.lower()) if n and f else None
        want[i] = (k is not None and (k in known or k in seen), at.get(k))
        seen.add(k)
    assert got == want


def test_no_pair_is_left_to_chance():
    """Sets of 8 inside sets of 11 that have no block in common in any rotation."""
    codes = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, (40_000, 11))[[8982, 24034, 28655, 34099, 38662]]
    found = []
    for width, probe in ((8, False), (11, True)):
        batch = pa.RecordBatch.from_arrays(
            [pa.array([0] * 5), pa.array(codes[:, :width].tolist(), pa.list_(pa.int64())), pa.array(range(5)), pa.array([1] * 5, pa.int32())],
            names=["scope_hash", "codes", "cid", "batch"],
        )
        out = pa.Table.from_batches(batch_dedup._signatures(0.7, np.zeros(0, np.uint64), probe)(iter([batch])))
        found.append(set(zip(out["key"].to_pylist(), out["cid"].to_pylist(), strict=True)))
    assert {cid for _, cid in found[0] & found[1]} == set(range(5))
