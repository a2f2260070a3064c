import random

from cairnfold.llm.source_mixing import mix, share_report

SIZES = "doc_id long, source string, n_tokens long, repeats int, _g int"
TARGETS = "source string, target_share double, max_repeats int"


def _mix(spark, docs, targets, **how):
    df = spark.createDataFrame([(*x, 5, 6) for x in docs], SIZES)
    t = spark.createDataFrame(targets, TARGETS)
    chosen, plan = mix(df, t, **how)
    return chosen.collect(), {x.source: x for x in share_report(chosen, plan).collect()}


def _docs(seed, sizes):
    r = random.Random(seed)
    out, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            out.append((i, r.choice([s, f" {s.upper()} "]), int(r.lognormvariate(5, 0.8)) + 1))
            i += 1
    return out


def test_shares_and_caps(spark):
    docs = _docs(1, {"web": 3000, "code": 800, "mail": 60, "other": 500})
    docs += [(-1, None, 50), (-2, "web", 0), (-3, "web", None)]
    targets = [("Web", 0.5, 1), ("code ", 0.3, 2), ("mail", 0.1, 4), ("none", 0.1, 3), ("other", None, 9)]
    chosen, report = _mix(spark, docs, targets, group=100)
    assert {x.source for x in chosen} == {"web", "code", "mail"}
    assert all(x.doc_id >= 0 for x in chosen)
    assert len({x.doc_id for x in chosen}) == len(chosen)
    for x in chosen:
        assert 1 <= x.repeats <= {"web": 1, "code": 2, "mail": 4}[x.source]
    assert report["none"].tokens == 0 and report["none"].available_documents == 0
    for s, t in (("web", 0.5), ("code", 0.3), ("mail", 0.1)):
        assert abs(report[s].reached_share - t / 0.9) < 0.01
        assert report[s].tokens == sum(x.n_tokens * x.repeats for x in chosen if x.source == s)
        assert abs(sum(x.repeats for x in chosen if x.source == s) - report[s].expected_copies * report[s].available_documents) <= 1.001
    # one source is used up to its cap: no larger total has the same shares
    assert any(x.expected_copies >= x.max_repeats - 0.01 for x in report.values() if x.tokens)


def test_a_given_total_may_be_out_of_reach(spark):
    docs = _docs(2, {"a": 400, "b": 20})
    total = 2 * sum(n for _, s, n in docs if s.strip().lower() == "a")
    chosen, report = _mix(spark, docs, [("a", 0.4, 1), ("b", 0.6, 3)], total=total)
    assert report["b"].expected_copies == 3 and all(x.repeats == 3 for x in chosen if x.source == "b")
    assert report["b"].reached_share < 0.6


def test_same_seed_same_documents(spark):
    docs = _docs(3, {"a": 200, "b": 300})
    targets = [("a", 0.5, 1), ("b", 0.5, 1)]
    assert sorted(_mix(spark, docs, targets, seed=1)[0]) == sorted(_mix(spark, docs[::-1], targets, seed=1)[0])
    assert sorted(_mix(spark, docs, targets, seed=1)[0]) != sorted(_mix(spark, docs, targets, seed=2)[0])


def test_repeated_rows_nulls_and_empty_tables(spark):
    docs = _docs(4, {"a": 50})
    once, _ = _mix(spark, docs, [("a", 1.0, None)])
    twice, _ = _mix(spark, docs + docs, [("a", 1.0, None), ("a", 1.0, None)])
    assert sorted(once) == sorted(twice) and len(once) == 50
    assert _mix(spark, docs, [])[0] == []
    assert _mix(spark, [], [("a", 1.0, 2)])[0] == []
    assert _mix(spark, docs, [("a", 1.0, 0)])[0] == []


def test_sources_without_a_target_are_reported(spark):
    docs = [*_docs(5, {"a": 30, "b": 20, "c": 10}), (-1, None, 50)]
    df = spark.createDataFrame([(*x, 5, 6) for x in docs + docs[:5]], SIZES)
    t = spark.createDataFrame([("a", 1.0, 1), ("b", None, 2)], TARGETS)
    rows = {x.source: x for x in share_report(*mix(df, t), df).collect()}
    assert set(rows) == {"a", "b", "c", None}
    assert rows["a"].tokens == rows["a"].available_tokens
    assert rows[None].available_documents == 1 and rows["c"].available_documents == 10
    assert all(rows[s].target_share is None and rows[s].tokens == 0 for s in ("b", "c", None))
