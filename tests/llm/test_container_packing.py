import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnfold.llm import container_packing
from cairnfold.llm.container_packing import fill_report, pack, plan


def _check(counts, capacity):
    p = plan(counts, capacity)
    got = Counter()
    for n, config in p.configurations:
        assert n > 0 and sum(s * k for s, k in config.items()) <= capacity
        for s, k in config.items():
            got[s] += n * k
    assert got == Counter({s: n for s, n in counts.items() if n})
    assert p.containers >= p.bound
    return p


@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=12))
@settings(max_examples=60, deadline=None)
def test_every_item_is_planned_once(counts):
    _check(counts, 60)


def test_plans_are_near_the_bound():
    r = random.Random(1)
    for capacity in (512, 2048):
        counts = Counter(min(capacity, max(1, int(r.lognormvariate(5.5, 1)))) for _ in range(20_000))
        p = _check(dict(counts), capacity)
        assert p.containers <= p.bound * 1.01 + 2


def test_most_containers_come_from_priced_configurations():
    r = random.Random(3)
    for capacity in (512, 2048, 8192):
        counts = Counter(min(capacity, max(1, int(r.lognormvariate(5.5, 1.3)))) for _ in range(6000))
        p = _check(dict(counts), capacity)
        assert p.priced >= 0.9 * p.containers


def test_segments_give_the_same_plan(monkeypatch):
    r = random.Random(4)
    counts = dict(Counter(r.randrange(1, 700) for _ in range(900)))
    whole = plan(counts, 1000)
    monkeypatch.setattr(container_packing, "SEGMENT", 2000)
    assert plan(counts, 1000) == whole


def test_exact_fits():
    assert _check({3: 100, 7: 100}, 10).containers == 100
    assert _check({6: 10}, 10).containers == 10
    assert _check({6: 10}, 10).bound == 10


def test_one_size_beyond_the_capacity_is_an_error():
    with pytest.raises(ValueError):
        plan({11: 1}, 10)


SIZES = "doc_id long, n_tokens long, limit_id int, l string"


def _pack(spark, sizes, limits):
    df = spark.createDataFrame([(*x, 1, "clash") for x in sizes], SIZES)
    lim = spark.createDataFrame(limits, "limit_id int, capacity_tokens int")
    placed, plans = pack(df, lim, group=64)
    return placed.collect(), fill_report(placed, lim, plans).collect()


def test_pack(spark):
    r = random.Random(2)
    sizes = [(i, r.choice([0, None, 7, 7, 7, r.randrange(1, 40), 130])) for i in range(500)]
    rows, report = _pack(spark, sizes + sizes[:25], [(1, 20), (2, 64), (2, 64), (3, None), (4, 0)])
    assert {x.limit_id for x in rows} == {1, 2}
    for limit, capacity in ((1, 20), (2, 64)):
        own = [x for x in rows if x.limit_id == limit]
        fill, parts = Counter(), Counter()
        for x in own:
            assert x.size <= capacity
            parts[x.doc_id] += 1
            if x.container_id is not None:
                fill[x.container_id] += x.size
            else:
                assert x.size == 0
        assert max(fill.values()) <= capacity
        for i, n in sizes:
            assert parts[i] == (max(1, -(-n // capacity)) if n else 1)
            assert sum(x.size for x in own if x.doc_id == i) == (n or 0)
        rep = next(x for x in report if x.limit_id == limit)
        assert rep.containers == len(fill) and rep.tokens == sum(n or 0 for _, n in sizes)
        assert rep.unused_tokens == capacity * len(fill) - rep.tokens and rep.least_containers <= rep.containers
        assert sorted(fill) == list(range(1, len(fill) + 1))


def test_empty(spark):
    assert _pack(spark, [], [(1, 10)]) == ([], [])
    rows, _ = _pack(spark, [(1, 5)], [])
    assert rows == []
