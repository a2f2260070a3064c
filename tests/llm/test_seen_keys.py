import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnfold.llm.seen_keys import CodedSet, SeenKeys, audit, coded_set, seen_before


@given(st.lists(st.integers(0, 2**20 - 1), max_size=600), st.integers(0, 12))
@settings(max_examples=60, deadline=None)
def test_coded_set_gives_back_what_it_holds(values, bits):
    values = np.unique(np.array(values, np.int64))
    scope = max(2**20, max(1, len(values)) << bits)
    s = CodedSet.of(values, scope, block=16)
    assert (s.values() == values).all()
    asked = np.unique(np.r_[values, np.minimum(values + 1, scope - 1), np.arange(50)])
    assert (s.has(asked) == np.isin(asked, values)).all()


def test_coded_set_is_small():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 100_000 << 10, 100_000))
    s = CodedSet.of(values, 100_000 << 10)
    assert len(s.data) * 8 / len(values) < 12.2
    assert abs(s.rate - 2**-10) < 1e-5


HISTORY = "namespace string, fp string, _k_fp string, h long"
INTAKE = "chunk_id long, batch_no int, namespace string, fp string, _order int, shard int"


def _frames(spark, history, intake):
    return spark.createDataFrame([(*x, "clash", 1) for x in history], HISTORY), spark.createDataFrame([(*x, 1, 2) for x in intake], INTAKE)


def _truth(history, intake):
    known = {(n, f.lower()) for n, f in history if n is not None and f is not None}
    first = {}
    for c, _, n, f in intake:
        if n is not None and f is not None:
            k = (n, f.lower())
            first[k] = min(first.get(k, c), c)
    return {c for c, _, n, f in intake if n is not None and f is not None and ((n, f.lower()) in known or first[n, f.lower()] < c)}


def _data(seed, n=1500):
    r = random.Random(seed)
    fps = ["%064x" % r.getrandbits(256) for _ in range(400)]
    history = [(r.choice(["a", "b", None]), r.choice([*fps[:200], None])) for _ in range(600)]
    intake = []
    for i in range(n):
        fp = fps[0] if r.random() < 0.35 else r.choice([*fps, None, "", "Plain"])
        intake.append((i, i // 100, r.choice(["a", "b", "c", None]), fp.upper() if fp and r.random() < 0.3 else fp))
    return history + history[:50], intake + intake[:60]


@pytest.mark.parametrize("bits", [1, 10])
@pytest.mark.parametrize("heavy", [0.002, 0.9])
def test_seen_before(spark, bits, heavy):
    history, intake = _data(3)
    h, c = _frames(spark, history, intake)
    got = [x.chunk_id for x in seen_before(h, c, bits=bits, shard_keys=200, heavy_share=heavy).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _truth(history, intake)


def test_empty_tables(spark):
    history, intake = _data(4, 200)
    h, c = _frames(spark, history, intake)
    none_h, none_c = _frames(spark, [], [])
    assert {x.chunk_id for x in seen_before(none_h, c).collect()} == _truth([], intake)
    assert seen_before(h, none_c).count() == 0
    assert seen_before(none_h, none_c).count() == 0


def test_null_batch_comes_last(spark):
    h, c = _frames(spark, [], [(1, 1, "a", "x"), (2, None, "a", "x"), (3, None, "a", "y")])
    assert {x.chunk_id for x in seen_before(h, c).collect()} == {2}


def test_audit_counts_wrong_answers(spark):
    r = random.Random(5)
    history = [("a", "%064x" % r.getrandbits(256)) for _ in range(4000)]
    intake = [(i, i // 1000, "a", "%064x" % r.getrandbits(256)) for i in range(4000)]
    h, c = _frames(spark, history, intake)
    rows = audit(h, c, bits=4).collect()
    wrong, expected = sum(x.wrong_yes for x in rows), sum(x.expected_wrong for x in rows)
    assert sum(x.wrong_no for x in rows) == 0
    assert expected > 200 and abs(wrong - expected) < 6 * expected**0.5


def test_blocks_hold_each_key_once(spark):
    df = spark.range(5000).selectExpr("xxhash64(id % 1000) as h")
    blocks = coded_set(df, 3, 1000 << 12).collect()
    assert sum(b["count"] for b in blocks) == 1000


def test_the_rows_of_history_are_the_same_without_a_filter(spark):
    history, intake = _data(6)
    h, c = _frames(spark, history, intake)
    assert {x.chunk_id for x in seen_before(h, c, filter_bytes=0).collect()} == _truth(history, intake)


def test_batches_are_appended_and_merged(spark, tmp_path):
    history, intake = _data(7)
    h, c = _frames(spark, history, intake)
    truth, got = _truth(history, intake), set()
    store = SeenKeys(spark, str(tmp_path / "keys"), 4000, shard_keys=1500)
    store.append(h.where("namespace is not null and fp is not null").selectExpr("xxhash64(namespace, lower(fp)) as h").limit(0))
    seen_before(spark.createDataFrame([], HISTORY), h.selectExpr("row_number() over (order by namespace) as chunk_id", "0 as batch_no", "namespace", "fp"), store=store).count()
    for low, high in ((0, 3), (3, 4), (4, 20)):
        own = SeenKeys(spark, str(tmp_path / "keys"))  # as another session opens it
        assert (own.shards, own.scope) == (store.shards, store.scope)
        before = h.select("namespace", "fp").union(c.where(f"batch_no < {low}").select("namespace", "fp"))
        got |= {x.chunk_id for x in seen_before(before, c.where(f"batch_no >= {low} and batch_no < {high}"), store=own).collect()}
    assert got == truth
    assert len(store.generations()) < 4
    rate = sum(b["count"] for b in store.blocks().collect()) / (store.shards * store.scope)
    assert 0 < rate < 2**-10
