"""Problems 1 and 5 against brute force, with dirty, empty and skewed tables."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairnfold.operators.heavy_keys import key_loads, overloading, scattered_groups
from cairnfold.operators.orphan_refs import Reference, orphan_references, orphan_report

T0 = datetime(2024, 1, 31, 12)
REFS = "namespace string, id string, dcid bigint, at timestamp, tbl string, reason string, _key bigint"
TARGETS = "namespace string, dcid bigint, sealed_at timestamp, n_blocks int"
GONE = "namespace string, dcid bigint, queued_at timestamp"


def _tables(spark, refs, targets, gone):
    return (
        spark.createDataFrame([(*r, "x", "y", 7) for r in refs], REFS),
        spark.createDataFrame([(*t, None) for t in targets], TARGETS),
        spark.createDataFrame([(*g, None) for g in gone], GONE),
    )


def _truth(refs, targets, gone):
    since = {}
    for ns, d, at in targets:
        if (ns, d) not in since or at < since[ns, d]:
            since[ns, d] = at
    out = set()
    for ns, i, d, at in refs:
        if d is None:
            continue
        reason = None
        if ns is None or (ns, d) not in since:
            reason = "missing"
        elif (ns, d) in {(a, b) for a, b in gone}:
            reason = "deleted"
        elif at is not None and since[ns, d] is not None and since[ns, d] > at:
            reason = "later"
        if reason:
            out.add(("t", i, d, at.strftime("%Y-%m") if at else None, reason))
    return out


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_orphans(spark, broadcast_bytes):
    r = random.Random(1)
    day = lambda: T0 + timedelta(hours=r.randrange(96))
    refs = [(r.choice("abc"), str(i), r.randrange(30), day()) for i in range(600)] + [("a", f"hot{i}", 99, day()) for i in range(400)]
    refs += [(None, "n", 1, T0), ("a", "null", None, T0), ("a", "never", 2, None), refs[0], refs[0]]
    targets = [(ns, d, day()) for ns in "abc" for d in range(0, 30, 2)]
    targets += targets[:3]
    gone = [("a", 2), ("b", 4), ("b", 4), ("z", 1), (None, 3)]
    ref, tgt, out = _tables(spark, refs, targets, gone)
    spec = {"t": Reference(ref, "namespace", "dcid", "at", F.col("id"))}
    got = orphan_references(spec, tgt, out, broadcast_bytes=broadcast_bytes)
    truth = _truth(refs, targets, gone)
    assert {tuple(x) for x in got.collect()} == truth
    report = orphan_report(spec, tgt, out, broadcast_bytes=broadcast_bytes).collect()
    assert sum(x.orphans for x in report) == len(truth)
    assert sum(x.refs for x in report) == sum(1 for x in refs if x[2] is not None)
    assert sum(x.missing for x in report) == sum(1 for x in truth if x[4] == "missing")


def test_orphans_of_empty_tables(spark):
    ref, tgt, out = _tables(spark, [], [], [])
    spec = {"t": Reference(ref, "namespace", "dcid", "at", F.col("id"))}
    assert orphan_references(spec, tgt, out).count() == 0
    ref, _, _ = _tables(spark, [("a", "1", 1, T0)], [], [])
    spec = {"t": Reference(ref, "namespace", "dcid", "at", F.col("id"))}
    assert [x.reason for x in orphan_references(spec, tgt, out).collect()] == ["missing"]


def _loads_truth(rows):
    once = set(rows)
    out = {}
    for name, at in (("fp", 2), ("dcid", 3)):
        count, rec, size, groups = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
        for x in rows:
            count[x[at]] += 1
        for x in once:
            rec[x[at]] += 1
            size[x[at]] += x[4] or 0
            if x[0] is not None:
                groups[x[at]].add(x[0])
        for k in count:
            if k is not None:
                out[name, str(k)] = (count[k], rec[k], size[k], len(groups[k]))
    return out


@pytest.mark.parametrize("split_rows, partitions, broadcast_bytes", [(16, 1, 1 << 20), (1 << 18, 3, 1 << 20), (64, 5, 0), (1 << 18, 1, 1 << 20)])
def test_key_loads(spark, split_rows, partitions, broadcast_bytes):
    r = random.Random(2)
    hexes = ["%064x" % r.getrandbits(256) for _ in range(20)]
    rows = []
    for i in range(1500):
        m = r.choice(["big", *[f"m{k}" for k in range(40)]])
        fp = hexes[0] if r.random() < 0.4 else r.choice([*hexes, None, "short", "", "z" * 64])
        rows.append((m if r.random() > 0.02 else None, i, fp, 7 if r.random() < 0.5 else r.choice([None, -3, 2**40, r.randrange(50)]), r.choice([None, 0, 10, 2**33])))
    rows += rows[:200]
    df = spark.createDataFrame([(*x, 1, "e") for x in rows], "manifest_id string, ordinal int, fp string, dcid bigint, len bigint, part int, block string").repartition(partitions)
    got = key_loads(df, ["fp", "dcid"], "manifest_id", ["manifest_id", "ordinal"], "len", split_rows=split_rows, broadcast_bytes=broadcast_bytes)
    mine = {(x.key_col, x.key_val): (x.deliveries, x.records, x.bytes, x.groups) for x in got.collect()}
    assert mine == _loads_truth(rows)
    top = {tuple(x) for x in overloading(got, len(rows), 0.3).collect()}
    assert top == {k for k, v in mine.items() if v[0] >= 0.3 * len(rows)}


def test_key_loads_shuffles_only_scattered_groups(spark):
    rows = [(f"m{i // 50}", i, f"f{i % 7}", i % 3, 1) for i in range(1000)] + [("m0", 0, "f0", 0, 1), ("m19", 5000, "f1", 1, 1)]
    df = spark.createDataFrame(rows, "manifest_id string, ordinal int, fp string, dcid bigint, len bigint").coalesce(1)
    found, some, n = scattered_groups(df, "manifest_id", 1 << 18)
    assert (some, n) == (0, 1002)
    found, some, n = scattered_groups(df.repartition(2), "manifest_id", 1 << 18)
    assert (some, n) == (20, 1002)


def test_key_loads_of_an_empty_table(spark):
    df = spark.createDataFrame([], "manifest_id string, ordinal int, fp string, dcid bigint, len bigint")
    assert key_loads(df, ["fp", "dcid"], "manifest_id", ["manifest_id", "ordinal"], "len").count() == 0
