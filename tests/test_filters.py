import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.operators.query import count_group, run_filter, run_group
from emberlog.plans.filters import FilterError, Validator, check_subscription_id, estimated_cost, fully_restricted, may_count, parse_filter, parse_group, sketch_offset, without_required_tags

A, B = "a" * 64, "b" * 64


def make_log(spark, events):
    """events: (created_at, kind, {tag: values}, pubkey, content)."""
    rows = []
    for i, (at, kind, tags, *rest) in enumerate(events, 1):
        rows.append((i, at, rest[0] if rest else A, f"{i:064x}", kind, [(k, v) for k, vs in tags.items() for v in vs], rest[1] if len(rest) > 1 else ""))
    log = spark.createDataFrame(rows, "lev_id bigint, created_at bigint, pubkey string, id string, kind int, idx_tags array<struct<name:string,value:string>>, content string")
    return log.selectExpr("*", "transform(idx_tags, t -> array(t.name, t.value)) as tags")


@pytest.mark.parametrize(
    "bad",
    [
        {"ids": []}, {"ids": ["zz"]}, {"ids": [A[:-1]]}, {"authors": [A.upper()]}, {"kinds": []}, {"kinds": [65536]}, {"kinds": [-1]}, {"kinds": [True]}, {"kinds": [1.5]}, {"#t": []}, {"#tt": ["x"]}, {"#1": ["x"]}, {"&tt": ["x"]},
        {"#t": ["x" * 256]}, {"#p": ["x"]}, {"since": -1}, {"limit": "5"}, {"search": 5}, {"search": "a:b"}, {"foo": 1}, {"search": "x" * 1025}, {"#a": ["1"], "#b": ["1"], "#c": ["1"], "#d": ["1"]}, {"&t": [str(i) for i in range(17)]}, [], "nope",
    ],
)
def test_refused(bad):
    with pytest.raises(FilterError):
        parse_filter(bad if isinstance(bad, str) else json.dumps(bad))


def test_duplicate_keys_are_refused():
    with pytest.raises(FilterError):
        parse_filter('{"kinds":[1],"kinds":[2]}')


def test_normal_form():
    f = parse_filter({"#t": ["b", "a", "b", "c"], "&t": ["c"], "limit": 10_000, "kinds": [7, 1, 7]})
    assert f.any_tags == {"t": ("a", "b")} and f.all_tags == {"t": ("c",)} and f.limit == 500 and f.kinds == (1, 7)
    assert parse_filter({"#t": ["x"], "&t": ["x"]}).any_tags == {}
    assert parse_filter({}).is_full_scan and not parse_filter({"kinds": [1]}).is_full_scan
    assert parse_filter({"authors": [A], "kinds": [1]}).is_index_only and not parse_filter({"&t": ["x"]}).is_index_only


def test_cost():
    cost = lambda *fs, **k: estimated_cost([parse_filter(f) for f in fs], **k)
    assert cost({"search": "x"}) == 250 and cost({"ids": [A, B]}) == 2 and cost({"&t": ["x", "y"]}) == 75 and cost({"#t": ["x"], "#d": ["y"]}) == 50
    assert cost({"authors": [A], "kinds": [1]}) == 5 and cost({"authors": [A, B]}) == 20 and cost({"kinds": [1, 2]}) == 200 and cost({"since": 1}) == 500 and cost({}) == 1000
    assert cost({}, {"kinds": [1]}, count_only=True) == 2200


def test_validator_and_restricted():
    with pytest.raises(FilterError):
        Validator(max_filters=1).check(parse_group([{}, {}]))
    with pytest.raises(FilterError):
        Validator(allowed_kinds=frozenset({1})).check(parse_group([{"kinds": [2]}]))
    with pytest.raises(FilterError):
        Validator(scoped=True).check(parse_group([{"authors": [A, B]}]))
    Validator(scoped=True).check(parse_group([{"&p": [A]}]))
    assert fully_restricted(parse_group([{"kinds": [4]}]), {4}) and not fully_restricted(parse_group([{"kinds": [4, 1]}]), {4})
    assert may_count(parse_group([{"kinds": [1]}]), {4}, None) and not may_count(parse_group([{}]), {4}, None)
    assert may_count(parse_group([{"kinds": [4], "#p": [A]}]), {4}, A) and not may_count(parse_group([{"kinds": [4], "#p": [A, B]}]), {4}, A)


def test_subscription_ids():
    assert check_subscription_id("sub:1!") == "sub:1!"
    for bad in ("", "x" * 65, 'a"b', "a\\b", "é", "a\n"):
        with pytest.raises(FilterError):
            check_subscription_id(bad)


def test_sketch_offsets():
    e = "0" * 32 + "f" + "0" * 31
    assert sketch_offset(parse_group([{"#e": [e]}])) == 23
    assert sketch_offset(parse_group([{"#a": [f"30023:{'0' * 32}a{'0' * 31}:x"]}])) == 18
    assert sketch_offset(parse_group([{"#e": [e, A]}])) is None and sketch_offset(parse_group([{"#e": [e]}, {}])) is None and sketch_offset(parse_group([{"&e": [e]}])) is None


def test_limit(spark):
    log = make_log(spark, [(i, 1, {}) for i in range(10)] + [(99, 0, {})])
    assert run_filter(log, parse_filter({"kinds": [1], "limit": 5})).count() == 5


def test_and_tags(spark):
    log = make_log(spark, [(100, 1, {"t": ["meme", "cat", "black"]}), (200, 1, {"t": ["meme", "cat", "white"]}), (300, 1, {"t": ["meme", "cat"]}), (400, 1, {"t": ["meme", "black"]})])
    f = parse_filter({"&t": ["meme", "cat"], "#t": ["meme", "cat", "black", "white"]})
    assert [r.created_at for r in run_filter(log, f).collect()] == [200, 100]
    assert count_group(log, [f], 100).first() == (2, False)


def test_request_cap_is_not_a_count_cap(spark):
    log = make_log(spark, [(i, 1, {}) for i in range(5)] + [(9, 0, {})])
    fs = parse_group([{"kinds": [1]}, {"kinds": [0]}])
    assert run_group(log, fs, cap=3).count() == 3 and count_group(log, fs, 1000).first() == (6, False)


def test_count_cap(spark):
    log = make_log(spark, [(i, 1, {}) for i in range(5)] + [(i, 3, {}) for i in range(5)])
    assert count_group(log, parse_group([{"kinds": [1]}, {"kinds": [3]}]), 7).first() == (7, True)


def test_limit_counts_what_earlier_filters_sent(spark):
    log = make_log(spark, [(i, 1, {}) for i in range(6)])
    out = run_group(log, parse_group([{"kinds": [1], "limit": 2}, {"kinds": [1], "limit": 3}])).collect()
    assert [(r.created_at, r.filter_idx) for r in out] == [(5, 0), (4, 0), (3, 1)]


EVENTS = st.lists(st.tuples(st.integers(0, 20), st.sampled_from([0, 1, 7]), st.sets(st.sampled_from("abcd"), max_size=3)), max_size=12)


@settings(max_examples=12, deadline=None)
@given(EVENTS, st.sets(st.sampled_from("abcd"), min_size=1, max_size=3), st.sets(st.sampled_from("abcd"), min_size=1, max_size=2), st.integers(0, 20), st.integers(0, 20))
def test_matches_naive(spark, events, some, every, since, until):
    log = make_log(spark, [(at, k, {"t": sorted(ts)}) for at, k, ts in events])
    f = parse_filter({"#t": sorted(some), "&t": sorted(every), "since": since, "until": until, "kinds": [0, 1]})
    left = some - every
    want = sorted(i for i, (at, k, ts) in enumerate(events, 1) if k in (0, 1) and since <= at <= until and every <= ts and (not left or left & ts))
    assert sorted(r.lev_id for r in run_filter(log, f).collect()) == want
    wide = {r.lev_id for r in run_filter(log, without_required_tags(f)).collect()}
    assert not left or wide >= set(want)
