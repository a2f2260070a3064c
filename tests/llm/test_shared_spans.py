import random

import numpy as np
import pytest

from cairnfold.llm.shared_spans import _range_min, shared_spans, sharing_report, windows

SCHEMA = "manifest_id string, ordinal int, fp string, len bigint, piece int, record string, code string"


def _frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "clash", None) for x in rows], SCHEMA)


def _truth(rows, least):
    """Every maximal run that two manifests have in common, by comparing all pairs of places."""
    by = {}
    for m, o, f, n in rows:
        if m is not None and o is not None:
            by.setdefault(m, {}).setdefault(o, (f.lower() if f else f, n))
    out = set()
    names = sorted(by)
    for a in names:
        for b in names:
            if a == b:
                continue
            x, y = by[a], by[b]
            for i in x:
                for j in y:
                    same = lambda k: x.get(i + k) is not None and x.get(i + k) == y.get(j + k) and None not in x[i + k] and x[i + k][1] >= 0  # noqa: B023, E731
                    if same(-1) or not same(0):
                        continue
                    k = 0
                    while same(k):
                        k += 1
                    if sum(x[i + t][1] for t in range(k)) >= least:
                        out |= {(a, i + t) for t in range(k)}
    return out


def _rows(seed, n_manifests=12, length=30):
    r = random.Random(seed)
    fps = ["%064x" % r.getrandbits(256) for _ in range(14)]
    sizes = {f: r.choice([0, 1, 3, 10, 25]) for f in fps}
    template = [r.choice(fps) for _ in range(length)]
    rows = []
    for m in range(n_manifests):
        own = []
        while len(own) < length:
            if r.random() < 0.5:
                a = r.randrange(length)
                own += template[a : a + r.randrange(1, 12)]
            elif r.random() < 0.5:
                own += [fps[0]] * r.randrange(1, 6)
            else:
                own.append(r.choice([*fps, None]))
        for i, f in enumerate(own):
            n = sizes.get(f, 5)
            rows.append((f"m{m}", i if r.random() > 0.02 else i + 1000, f.upper() if f and r.random() < 0.2 else f, n if r.random() > 0.02 else r.choice([None, 7, -1])))
    seen, unique = set(), []
    for x in rows:
        if x[:2] not in seen:
            seen.add(x[:2])
            unique.append(x)
    return unique + unique[:20] + [(None, 1, fps[0], 10), ("m0", None, fps[0], 10)]


@pytest.mark.parametrize("least", [1, 20, 60])
@pytest.mark.parametrize(("piece", "rows", "byte_limit", "bucket_rows"), [(1 << 16, 1 << 18, 10**6, 10**6), (7, 40, 0, 10**6), (7, 40, 0, 2)])
def test_spans_against_all_pairs(spark, least, piece, rows, byte_limit, bucket_rows):
    data = _rows(least + piece % 5)
    got = shared_spans(_frame(spark, data), least, piece=piece, rows=rows, broadcast_bytes=byte_limit, bucket_rows=bucket_rows).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {(x.record, x.ordinal) for x in got} == _truth(data, least)


def test_long_chunks_count_alone(spark):
    f = "ab" * 32
    data = [("a", 0, f, 2**33), ("b", 5, f, 2**33), ("c", 0, f, 2**33 + 1), ("d", 0, f, 5)]
    assert {x.record for x in shared_spans(_frame(spark, data)).collect()} == {"a", "b"}


def test_fingerprints_count_in_full(spark):
    a, b = "ab" * 31 + "00", "ab" * 31 + "01"  # 248 equal bits
    data = [("m", 0, a, 30), ("n", 0, b, 30), ("o", 4, b.upper(), 30)]
    assert {x.record for x in shared_spans(_frame(spark, data), 20).collect()} == {"n", "o"}


def test_repetition_within_one_record_is_not_shared(spark):
    f = "cd" * 32
    data = [("a", i, f, 10) for i in range(50)]
    assert shared_spans(_frame(spark, data), 20).count() == 0


def test_empty_table_and_report(spark):
    assert shared_spans(_frame(spark, []), 20).count() == 0
    data = [("a", 0, "x", 30), ("a", 1, "y", 10), ("b", 0, "x", 30), ("c", 0, None, None), ("z", 0, "q", 0)]
    report = {x.record: (x.bytes, x.shared_bytes, x.shared_part) for x in sharing_report(_frame(spark, data), 20).collect()}
    assert report == {"a": (40, 30, 0.75), "b": (30, 30, 1.0), "c": (0, 0, None), "z": (0, 0, None)}


def test_windows_are_shortest():
    size = np.array([3, 0, 4, 10, 1, 1, 1])
    run = np.array([0, 0, 0, 0, 1, 1, 1])
    got = set(zip(*(x.tolist() for x in windows(size, run, 3)), strict=True))
    assert got == {(0, 0), (1, 2), (2, 2), (3, 3), (4, 6)} | {(0, 1)} - {(0, 1)} | ({(0, 1)} & got)


def test_range_min():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1000, 200).astype(np.uint64)
    s = rng.integers(0, 200, 300)
    e = np.minimum(199, s + rng.integers(0, 40, 300))
    assert (_range_min(v, s, e) == [v[a : b + 1].min() for a, b in zip(s, e, strict=True)]).all()
