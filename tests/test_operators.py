import hashlib

from pyspark.sql import functions as F

from emberlog.functions.terms import all_terms, indexed_bigrams, indexed_terms, parse_search, split_terms
from emberlog.operators import admission, maintain, query, sketch, state, subscriptions, visibility
from emberlog.operators.state import replay_rows
from emberlog.plans.filters import parse_filter, parse_group

from test_filters import A, B, make_log


def lev_ids(df):
    return sorted(r.lev_id for r in df.collect())


def test_phrase_beats_recency(spark):
    log = make_log(spark, [(100, 1, {}, A, "Old maps guide careful sailors"), (300, 1, {}, A, "Maps from every old harbour"), (400, 0, {}, A, "Old maps profile")])
    assert [r.created_at for r in query.run_filter(log, parse_filter({"search": "old maps", "kinds": [1], "limit": 1})).collect()] == [100]


def test_search_group_keeps_best(spark):
    log = make_log(spark, [(100, 1, {}, A, "usual one"), (200, 1, {}, A, "usual two"), (50, 1, {}, A, "seldom seen")])
    out = query.run_group(log, parse_group([{"search": "usual", "limit": 1}, {"search": "seldom", "limit": 1}])).collect()
    assert [r.content for r in out] == ["seldom seen", "usual two"]


def test_search_options_and_accents(spark):
    log = make_log(spark, [(1, 1, {}, A, "A CAFÉ by the harbour")])
    assert query.run_filter(log, parse_filter({"search": "café domain:example.com include:spam"})).count() == 1
    assert parse_search("a:b :c d: x").terms == ("c", "d", "x")


def test_hidden_hits_use_up_the_limit(spark):
    log = make_log(spark, [(1, 1, {}, A, "word"), (2, 1, {}, B, "word")])
    banned = spark.createDataFrame([(B,)], "pubkey string")
    out = query.search_filter(log, parse_filter({"search": "word", "limit": 1}), lambda x: visibility.without_banned(x, banned_authors=banned))
    assert out.count() == 0


def test_index_bounds(spark):
    text = " ".join(f"w{i}" for i in range(10_000))
    rows = spark.createDataFrame([(text,), ("repeat " * 512 + "last",), ("x" * 65 + " a b",), (f"a {'y' * 65} b",), (None,), ("",), ("İSTANBUL ΑΣ",)], "t string").select(all_terms(F.col("t")).alias("w")).select(indexed_terms(F.col("w")).alias("t"), indexed_bigrams(F.col("w")).alias("b")).collect()
    assert (len(rows[0].t), len(rows[0].b)) == (256, 256) and rows[1].t == ["repeat", "last"]
    assert rows[2].b == ["a b"] and rows[3].b == [] and rows[4].t == [] and rows[5].b == [] and rows[6].t == split_terms("İSTANBUL ΑΣ")[0] == ["i̇stanbul", "ασ"]


def test_sketch_registers(spark):
    rows = spark.createDataFrame([("0" * 64,), ("00" * 8 + "07" + "10" + "00" * 22,)], "pubkey string")
    assert {r.reg: r.rank for r in query.sketch_registers(rows, 8).collect()} == {0: 57, 7: 4}
    assert len(query.sketch_hex(query.sketch_registers(rows, 8)).first().hll) == 512
    assert query.sketch_hex(query.sketch_registers(rows.limit(0), 8)).first().hll == "0" * 512


def test_fingerprints(spark):
    ids = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(300)] + ["f" * 64] * 2
    rows = spark.createDataFrame([(i % 2, x) for i, x in enumerate(ids)], "g int, id string")
    for r in sketch.fingerprints(rows, ["g"]).collect():
        own = [x for i, x in enumerate(ids) if i % 2 == r.g]
        total = sum(int.from_bytes(bytes.fromhex(x), "little") for x in own) % (1 << 256)
        n = len(own)
        varint = bytes([n]) if n < 128 else bytes([n >> 7 | 128, n & 127])
        assert r.fp == hashlib.sha256(total.to_bytes(32, "little") + varint).hexdigest()[:32]


def test_ranges_and_reconcile(spark):
    log = make_log(spark, [(i // 3, 1, {}) for i in range(40)])
    sizes = sorted(r["count"] for r in sketch.split_range(log).groupBy("bucket").count().collect())
    assert sizes == [2] * 8 + [3] * 8
    assert {r.bucket for r in sketch.split_range(log.where("lev_id < 20")).collect()} == {0}
    assert sketch.range_bounds(log).count() == 15
    out = sketch.reconcile(log.where("lev_id < 5"), log.where("lev_id > 3")).collect()
    assert len([r for r in out if r.side == "have"]) == 3 and len([r for r in out if r.side == "need"]) == 36


def vanish_log(spark):
    log = make_log(spark, [(100, 1, {}), (300, 1, {}), (150, 5, {}), (400, 1059, {"p": [A]}, B), (200, 62, {})])
    return log.withColumn("tags", F.when(F.col("kind") == 62, F.array(F.array(F.lit("relay"), F.lit("ALL_RELAYS")))).otherwise(F.col("tags")))


def test_vanish(spark):
    log = vanish_log(spark)
    markers = visibility.vanish_markers(log, [])
    assert [(r.pubkey, r.vanished_at) for r in markers.collect()] == [(A, 200)]
    assert lev_ids(visibility.without_vanished(log, markers)) == [2, 5]
    other = log.withColumn("tags", F.when(F.col("kind") == 62, F.array(F.array(F.lit("relay"), F.lit("wss://Other.example/")))).otherwise(F.col("tags")))
    assert visibility.vanish_markers(other, []).count() == 0 and visibility.vanish_markers(other, ["other.example"]).count() == 1


def event(i, kind, at, tags=(), author=A):
    return {"id": f"{i:064x}", "pubkey": author, "kind": kind, "created_at": at, "tags": [list(t) for t in tags]}


def test_replay_does_not_bring_back():
    rows = [event(1, 0, 1), event(2, 0, 2), event(3, 5, 3, [("e", f"{2:064x}")])]
    assert replay_rows(rows) == ["removed", "removed", "written"]


def test_replay_rules():
    relay = ("relay", "ALL_RELAYS")
    assert replay_rows([event(1, 1, 1), event(1, 1, 1)]) == ["written", "duplicate"]
    assert replay_rows([event(2, 0, 5), event(1, 0, 5)]) == ["removed", "written"]
    assert replay_rows([event(1, 0, 5), event(2, 0, 5)]) == ["written", "replaced"]
    assert replay_rows([event(9, 5, 1, [("e", f"{1:064x}")]), event(1, 1, 2)]) == ["written", "deleted"]
    assert replay_rows([event(1, 1, 1), event(2, 5, 2, [("e", f"{1:064x}")], B)]) == ["written", "written"]
    assert replay_rows([event(1, 30023, 1, [("d", "x")]), event(2, 5, 2, [("a", f"30023:{A}:x")]), event(3, 30023, 2, [("d", "x")]), event(4, 30023, 3, [("d", "x")])]) == ["removed", "written", "deleted", "written"]
    assert replay_rows([event(1, 62, 9, [("relay", "elsewhere")])]) == ["deleted"]
    assert replay_rows([event(1, 5, 150, [("e", f"{2:064x}")]), event(2, 62, 200, [relay]), event(3, 62, 175, [relay]), event(4, 1, 180), event(5, 1, 201)]) == ["written", "written", "written", "deleted", "written"]
    assert replay_rows([event(1, 1059, 1, [("p", A)], B), event(2, 5, 2, [("e", f"{1:064x}")]), event(1, 1059, 1, [("p", A)], B)]) == ["removed", "written", "deleted"]


def test_state_frames(spark):
    log = make_log(spark, [(1, 0, {}), (2, 0, {}), (1, 30023, {"d": ["x"]}), (3, 30023, {"d": ["x"]}), (1, 30023, {"d": ["y"]}), (1, 1, {})])
    assert lev_ids(state.latest_state(log)) == [2, 4, 5, 6]
    assert {(r.lev_id, r.status) for r in state.replay(log).collect()} == {(1, "removed"), (2, "written"), (3, "removed"), (4, "written"), (5, "written"), (6, "written")}
    assert lev_ids(state.without_expired(log, F.col("created_at"), 1)) == [2, 4, 6]
    gone = make_log(spark, [(5, 5, {"e": [f"{3:064x}"], "a": [f"30023:{A}:x"]}), (4, 30023, {"d": ["x"]}), (4, 1, {}), (6, 30023, {"d": ["x"]}), (1, 1, {}, B)])
    assert lev_ids(state.without_deleted(gone)) == [1, 4, 5]


def test_subscriptions(spark):
    log = make_log(spark, [(1, 1, {"t": ["x", "y"]}, A, "Hello big world"), (2, 7, {"t": ["x"]}, B, ""), (3, 1, {}, B, "world hello")])
    groups = {"a": [{"authors": [A]}, {"ids": [f"{2:064x}"]}], "t": [{"&t": ["x", "y"]}], "k": [{"kinds": [1], "since": 2}], "s": [{"search": "hello world"}], "o": [{"until": 2}]}
    subs = subscriptions.subscription_table(spark, [subscriptions.Subscription(1, k, tuple(parse_group(v)), 2 if k == "o" else 0) for k, v in groups.items()])
    found = {}
    for r in subscriptions.match(log, subs).collect():
        found.setdefault(r["sub"], set()).add(r.lev_id)
    assert found == {"a": {1, 2}, "t": {1}, "k": {3}, "s": {1, 3}}
    assert {(r["sub"], r.mark) for r in subscriptions.advanced_marks(subscriptions.match(log, subs)).collect()} == {("a", 2), ("t", 1), ("k", 3), ("s", 3)}


def test_admission(spark):
    log = make_log(spark, [(1000, 1, {}), (10, 1, {}), (5000, 1, {}), (1000, 9, {}), (1000, 1, {}, B), (1000, 20001, {}), (10, 62, {}), (1000, 6, {}, A, 'x["-"]')])
    p = admission.Policy(now=1000, newer=100, older=500, ephemeral_older=10, allowed_kinds=(1, 6, 20001, 62))
    out = {r.lev_id: r.reason for r in admission.first_reason(log, p, banned_authors=spark.createDataFrame([(B,)], "pubkey string"), stored=log.where("lev_id = 6")).collect()}
    assert out == {1: None, 2: "created_at too early", 3: "created_at too late", 4: "kind not allowed", 5: "author banned", 6: "duplicate", 7: None, 8: "repost of a protected event"}
    assert lev_ids(admission.within_author_quota(log, 2)) == [1, 2, 5]
    acts = {r.lev_id: r.action for r in admission.apply_policy(log, lambda e: {1: "accept", 6: "shadowReject", 9: "what"}[e["kind"]]).collect()}
    assert acts == {1: "accept", 2: "accept", 3: "accept", 4: "reject", 5: "accept", 6: "reject", 7: "reject", 8: "shadowReject"}


def test_reports_and_control(spark):
    log = make_log(spark, [(1, 1984, {"e": [A, B]}, A, "one"), (2, 1984, {"e": [A]}, B, "two")])
    assert {(r.target, r.reporter, r.reason) for r in admission.report_queue(log).collect()} == {(A, B, "two"), (B, A, "one")}
    control = spark.createDataFrame([(1, "banpubkey", "x", "r"), (2, "unbanpubkey", "x", None), (3, "banpubkey", "y", "q"), (4, "allowpubkey", "z", None)], "seq int, method string, subject string, reason string")
    folded = admission.fold_control(control)
    assert {(r.subject, r.state) for r in folded.collect()} == {("y", "ban"), ("z", "allow")}
    roles = spark.createDataFrame([("w",)], "pubkey string")
    who = spark.createDataFrame([(c,) for c in "xyzw"], "pubkey string")
    assert {r.pubkey: r.permitted for r in admission.write_permitted(who, folded, roles, True).collect()} == {"x": False, "y": False, "z": True, "w": True}


def test_integrity_and_digest(spark):
    log = make_log(spark, [(1, 1, {"t": ["x", "x"]}), (2, 1, {})])
    index = maintain.expected_index(log)
    assert maintain.check_integrity(log, index).count() == 0
    assert maintain.integrity_totals(maintain.check_integrity(log, index.where("index_name != 'tag'"))).collect() == [("tag", 1, 0)]
    a, b = maintain.log_digest(log, "id"), maintain.log_digest(log.repartition(3), "id")
    assert a.first() == b.first() and maintain.log_digest(log.where("lev_id = 1"), "id").first().digest != a.first().digest
    stay, goes = maintain.delete_matching(log, [parse_filter({"#t": ["x"]})])
    assert lev_ids(stay) == [2] and lev_ids(goes) == [1]


def test_delete_by_search(spark):
    import pytest

    log = make_log(spark, [(1, 1, {}, A, "old maps"), (2, 1, {}, A, "old charts"), (3, 7, {}, B, "maps of old")])
    stay, goes = maintain.delete_matching(log, [parse_filter({"search": "maps old", "kinds": [1]})])
    assert lev_ids(stay) == [2, 3] and lev_ids(goes) == [1]
    assert lev_ids(maintain.delete_matching(log, [parse_filter({"search": "zzzznotaword"})])[0]) == [1, 2, 3]
    assert lev_ids(maintain.delete_matching(log, [], now=10, age=8)[1]) == [1, 2]
    for bad in ({"filters": []}, {"filters": [parse_filter({"until": 3})], "now": 10, "age": 1}):
        with pytest.raises(ValueError):
            maintain.delete_matching(log, **bad)


def test_hand_over_with_search(spark):
    from emberlog.streaming import live

    log = make_log(spark, [(1, 1, {}, A, "old maps"), (2, 1, {}, A, "new maps"), (3, 1, {}, A, "maps, old ones"), (4, 1, {}, A, "charts")])
    history, later = live.hand_over(log, parse_group([{"search": "old maps"}]), 2)
    assert lev_ids(history) == [1] and lev_ids(later(log)) == [3]


def test_relay_names():
    aim = lambda url: [event(1, 62, 9, [("relay", url)])]
    assert replay_rows(aim("wss://My.Relay/"), ("my.relay",)) == ["written"] and replay_rows(aim(" ws://my.relay// "), ("wss://MY.relay",)) == ["written"]
    assert replay_rows(aim("wss://other.relay"), ("my.relay",)) == ["deleted"] and replay_rows(aim(""), ("",)) == ["deleted"]


def test_quota_forgets_refused_batches(spark):
    log = spark.createDataFrame([(i,) for i in [*range(0, 10), 10, 11, 20]], "lev_id long")
    assert [r.accepted for r in admission.batches_within_quota(log, 11, 10).orderBy("batch_no").collect()] == [True, False, True]


def test_large_counts_and_sums(spark):
    """Counts beyond 2^28 and sums of that many ids, from limb sums."""
    for n in (1, 127, 128, 1 << 28, (1 << 35) + 5):
        value = int.from_bytes(bytes.fromhex("f" * 64), "little")
        limbs = [(value >> 16 * i & 0xFFFF) * n for i in range(sketch.LIMBS)]
        frame = spark.createDataFrame([(1, n, *limbs)], "g int, n long, " + ", ".join(f"s{i} long" for i in range(sketch.LIMBS)))
        varint, left = [n & 127], n >> 7
        while left:
            varint.insert(0, left & 127 | 128)
            left >>= 7
        want = hashlib.sha256((value * n % (1 << 256)).to_bytes(32, "little") + bytes(varint)).hexdigest()[:32]
        assert sketch.fingerprint_of(frame, ["g"]).first().fp == want


def test_places_and_differences(spark):
    log = make_log(spark, [((i * 7919) % 1000, i % 3, {}) for i in range(200)])
    rows, n = sketch.ranked(log)
    order = [(r.created_at, r.id) for r in rows.orderBy("__place").collect()]
    assert n == 200 and order == sorted(order) and sorted(r["__place"] for r in rows.collect()) == list(range(1, 201))
    later, earlier = (sketch.limb_sums(log.where(f"lev_id <= {k}"), ["kind"]) for k in (200, 90))
    assert sorted(sketch.difference(later, earlier, ["kind"]).collect()) == sorted(sketch.fingerprints(log.where("lev_id > 90"), ["kind"]).collect())


def test_bounds_of_the_moderation_state(spark):
    rows = [(i, "assignrole", "x", f"r{i}", "") for i in range(100, 200)] + [(i, "putrole", "", f"r{i + 100}", "") for i in range(100)] + [(500, "banpubkey", "y", None, "z" * 513)]
    control = spark.createDataFrame(rows, "seq int, method string, subject string, role string, reason string")
    kept = admission.accepted_control(control)
    assert kept.count() == 200
    assert sorted(r.role for r in admission.fold_roles(kept).collect()) == [f"r{i}" for i in range(100, 164)]
    reports = spark.createDataFrame([("a", "r"), ("b", "r")], "target string, reporter string")
    state_of = admission.fold_control(spark.createDataFrame([(1, "banevent", "a", "")], "seq int, method string, subject string, reason string"))
    assert [r.target for r in admission.open_reports(reports, state_of).collect()] == ["b"]


def test_roles_of_a_long_control_log(spark):
    """Random logs against a plain loop, and one whose assignments times its role rows are 5 * 10^9."""
    import random
    import threading

    for seed in range(5):
        rng = random.Random(seed)
        rows = [(i, rng.choice(["assignrole", "assignrole", "unassignrole", "putrole", "deleterole"]), rng.choice("xyz"), rng.choice(["admin", "r1", "r2", "r3"]), "") for i in range(60)]
        exists, held = {"admin"}, set()
        for _, method, who, role, _ in rows:
            if method == "putrole":
                exists.add(role)
            elif method == "deleterole":
                exists -= {role} - {"admin"}
                held = {h for h in held if h[1] != role}
            elif method == "unassignrole":
                held.discard((who, role))
            elif role in exists:
                held.add((who, role))
            else:
                held.discard((who, role))  # the last word counts
        control = spark.createDataFrame(rows, "seq int, method string, subject string, role string, reason string")
        assert {tuple(r) for r in admission.fold_roles(control).collect()} == held
    puts = spark.range(50_000).selectExpr("id as seq", "'putrole' as method", "'' as subject", "'curator' as role")
    assigned = spark.range(50_000, 150_000).selectExpr("id as seq", "'assignrole' as method", "cast(id as string) as subject", "'curator' as role")
    stop = threading.Timer(30, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        assert admission.fold_roles(puts.union(assigned)).count() == 100_000
    finally:
        stop.cancel()


def test_a_role_is_one_record_whoever_makes_it(spark):
    """1,100 authors make one role, then others have one each: the bound counts roles."""
    rows = [(i, "putrole", f"u{i}", "curator", "") for i in range(1100)] + [(1100 + i, "putrole", "u0", f"r{i}", "") for i in range(1001)] + [(5000, "banpubkey", "y", None, None)]
    control = spark.createDataFrame(rows, "seq int, method string, subject string, role string, reason string")
    kept = admission.accepted_control(control)
    assert kept.columns == control.columns
    assert sorted(r.seq for r in kept.collect()) == [*range(2099), 5000]
    no_roles = control.drop("role").where("method = 'banpubkey'")
    assert [r.seq for r in admission.accepted_control(no_roles).collect()] == [5000]
