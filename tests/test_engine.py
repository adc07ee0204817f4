"""Golden vectors, fences against a plain fold, batch against stream, order independence, lines of JSON."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from provlake.functions import expressions as x
from provlake.functions.digests import digest_of
from provlake.model import Policy
from provlake.operators import compose, diff, explain, hierarchy, ingest, query
from provlake.plans.history import History, NotFound
from provlake.plans.snapshots import Snapshot
from provlake.sources import events, ndjson, results
from provlake.streaming import fences, view

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_golden_vectors(spark):
    assert one(spark, x.typed("fabric", F.lit("fabric/test"))) == "fab:61bc292718a76c806736fcb7532fa7a0"
    assert one(spark, x.crc32c(F.lit(b"123456789"))) == 0xE3069283
    assert one(spark, x.crc32c(F.lit(b"\0" * 32))) == 0x8A9136AA
    for nanos, text in ((0, "1970-01-01T00:00:00.000000000Z"), (-1, "1969-12-31T23:59:59.999999999Z"), (1767225600000000000, "2026-01-01T00:00:00.000000000Z")):
        assert one(spark, x.format_utc(F.lit(nanos))) == text
        assert one(spark, x.parse_utc(F.lit(text))) == nanos
    assert one(spark, x.parse_utc(F.lit("9999-01-01T00:00:00Z"))) is None and one(spark, x.parse_utc(F.lit("2023-01-01T24:00:00Z"))) is None
    assert one(spark, x.parse_utc(F.lit("2023-02-31T00:00:00Z"))) == one(spark, x.parse_utc(F.lit("2023-03-03 00:00:00Z")))
    assert one(spark, x.canon(F.lit("real"), x.real_bits(F.lit(-0.0)))) == "r:8000000000000000"
    assert one(spark, x.parse_utc(F.lit("42"))) == 42 and one(spark, x.parse_utc(F.lit("soon"))) is None


@pytest.mark.parametrize("age, recovered, want", [(0, False, 0), (10, False, 0), (11, False, 1), (20, False, 1), (21, False, 2), (-5, False, 0), (0, True, 1), (21, True, 2)])
def test_freshness(spark, age, recovered, want):
    assert one(spark, x.freshness(F.lit(100), F.lit(100 - age), F.lit(100 - age), F.lit(recovered), 10, 20)) == want


def test_age_saturates(spark):
    assert one(spark, x.age(F.lit(x.MAX), F.lit(-x.MAX))) == x.MAX


CLAIM = "source string, incarnation string, sequence long, arrival_seq long, generation long, epoch long, subject string, aspect string, value string, supported boolean, recovered boolean, observed_at long, received_at long, revision long, event_id long"


def claim(source, value, sequence=1, generation=1, epoch=1, supported=True, at=100, incarnation="boot", aspect="link.state", n=1):
    return (source, incarnation, sequence, n, generation, epoch, "device/a", aspect, value, supported, False, at, at, 0, n)


@pytest.mark.parametrize(
    "claims, truth",
    [
        ([claim("a", "up"), claim("b", "up", n=2)], "known"),
        ([claim("a", "up"), claim("b", "down", n=2)], "conflicting"),
        ([claim("a", "up"), claim("a", "down", sequence=2, n=2)], "known"),
        ([claim("a", None, supported=False)], "unsupported"),
        ([claim("a", "up"), claim("b", "x", aspect="port.state", at=10**12, n=2)], "stale"),
        ([claim("a", "up", aspect="path.state")], "incomplete"),
        ([claim("a", "up"), claim("b", "down", generation=2, n=2)], "known"),
    ],
)
def test_truth_ladder(spark, claims, truth):
    states = Snapshot(spark.createDataFrame(claims, CLAIM), Policy()).aspects.collect()
    assert {s["truth"] for s in states if s["aspect"] == claims[0][7]} == {truth}


def test_snapshot_does_not_depend_on_order(spark):
    claims = events.load(spark, SF)
    first = Snapshot(claims, Policy(fresh=events.DAY, aging=3 * events.DAY)).digest().first()[0]
    assert Snapshot(claims.orderBy(F.rand(1)).repartition(7), Policy(fresh=events.DAY, aging=3 * events.DAY)).digest().first()[0] == first


def test_only_32_claims_are_retained(spark):
    claims = spark.createDataFrame([claim(f"s{k}", "up", n=k) for k in range(40)], CLAIM)
    assert compose.retained(Snapshot(claims, Policy()).records).count() == 32


def random_claims(seed):
    draw = random.Random(seed)
    out = []
    for n in range(400):
        at = 1000 * n + draw.choice((0, 0, 0, 10**10))
        out.append((f"s{draw.randint(0, 3)}", f"b{n // 150}" if draw.random() < 0.95 else "b0", max(0, n // 4 - draw.choice((0, 0, 1))), n, 1 + n // 200 - (draw.random() < 0.03), n // 100 % 3, f"device/{draw.randint(0, 2)}", "link.state", "up", True, False, at, 1000 * n, draw.choice((0, 0, n)), n))
    return out


def plain_fold(rows, scopes=None, strict=False):
    """The fences written down once more, for claims one to an observation: what each arrival comes to."""
    scopes, said, out = scopes or {}, {}, {}
    last, boots, revisions, high = {}, {}, {}, None
    for o in sorted(rows, key=lambda r: r["arrival_seq"]):
        s, key = o["source"], (o["source"], o["subject"], o["aspect"])
        own = last.get(s)
        words = tuple(v for k, v in sorted(o.items()) if k not in ("arrival_seq", "received_at", "event_id", "recovered"))

        def judge():
            if o["sequence"] < 1:
                return "rejected", "InvalidArgument"
            if o["observed_at"] > o["received_at"] + 5 * 10**9:
                return "rejected", "ClockInconsistent"
            if own and o["incarnation"] != own["incarnation"] and o["incarnation"] in boots[s][-8:]:
                return "rejected", "FencedIncarnation"
            if own and o["incarnation"] == own["incarnation"] and o["sequence"] <= own["sequence"]:
                again = o["sequence"] == own["sequence"] and said[s] == words
                return ("duplicate", "FencedDuplicateContent") if again else ("rejected", "FencedSequence")
            before = own or {"generation": 0, "epoch": 0}
            if o["generation"] < before["generation"]:
                return "rejected", "FencedStaleGeneration"
            if o["generation"] - before["generation"] > 1_000_000:
                return "rejected", "OutOfRange"
            if strict and high is not None and o["generation"] < high:
                return "rejected", "FencedStaleGeneration"
            if o["generation"] == before["generation"] and o["epoch"] < before["epoch"]:
                return "rejected", "FencedStaleEpoch"
            if scopes.get(s) and o["aspect"] not in scopes[s]:
                return "fenced", "FencedAuthority"
            if 0 < o["revision"] < revisions.get(key, 0):
                return "fenced", "FencedRevision"
            return "accepted", "Ok"

        out[o["arrival_seq"]] = judge()
        if out[o["arrival_seq"]][0] == "accepted":
            if not own or own["incarnation"] != o["incarnation"]:
                boots.setdefault(s, []).append(o["incarnation"])
            last[s], said[s] = o, words
            revisions[key] = max(revisions.get(key, 0), o["revision"])
            high = max(high or 0, o["generation"])
    return out


NAMES = [f.split()[0] for f in CLAIM.split(", ")]


@pytest.mark.parametrize("seed", range(3))
def test_fold_against_plain_python(spark, seed):
    rows = [dict(zip(NAMES, r)) for r in random_claims(seed)]
    again = [dict(r, arrival_seq=1000 + k) for k, r in enumerate(rows[-3:])]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows + again], CLAIM).repartition(3)
    got = {r["arrival_seq"]: (r["disposition"], r["code"]) for r in ingest.fold(frame).collect()}
    want = plain_fold(rows + again)
    assert got == want and len({c for _, c in want.values()}) > 4


def test_strict_fence_against_plain_python(spark):
    draw = random.Random(3)
    rows = [dict(zip(NAMES, claim(f"s{draw.randint(0, 4)}", "up", sequence=n + 1, generation=1 + n // 40 + draw.choice((0, 0, 1, 2) if draw.random() < 0.1 else (0,)), n=n))) for n in range(200)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], CLAIM).repartition(3)
    got = {r["arrival_seq"]: (r["disposition"], r["code"]) for r in ingest.admit_strictly(frame).collect()}
    want = plain_fold(rows, strict=True)
    assert got == want and want != plain_fold(rows)


def test_strict_fence_folds_once(spark, monkeypatch):
    """Where the first guess of the highs holds, no second fold follows."""
    rows = [dict(zip(NAMES, claim(f"s{n % 2}", "up", sequence=n + 1, generation=3 + n // 10 - n % 2, n=n))) for n in range(40)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], CLAIM).repartition(3)
    folds, real = [], ingest.admit
    monkeypatch.setattr(ingest, "admit", lambda *a, **k: folds.append(1) or real(*a, **k))
    got = {r["arrival_seq"]: (r["disposition"], r["code"]) for r in ingest.admit_strictly(frame).collect()}
    assert got == plain_fold(rows, strict=True) and len(folds) == 1


def test_old_boots_are_remembered(spark):
    """A boot that comes back after more than SEEN others is refused where all are remembered, and new where not."""
    boots = [f"b{k:02}" for k in range(ingest.SEEN + 4)]
    rows = [dict(zip(NAMES, claim("s", "up", sequence=k + 1, n=k))) | {"incarnation": b} for k, b in enumerate([*boots, boots[0]])]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], CLAIM).repartition(3)
    last = lambda **k: ingest.fold(frame, **k).orderBy("arrival_seq").collect()[-1]["code"]
    assert (last(boots=None), last()) == ("FencedIncarnation", "Ok")


def test_fences_by_name():
    from types import SimpleNamespace

    say = lambda **k: SimpleNamespace(**{"source": "s", "incarnation": "a", "sequence": 1, "generation": 5, "epoch": 2, "subjects": ["x"], "aspects": ["link.state"], "revisions": [0], "content": "c", "scope": None, "high": None} | k)
    s = ingest.Lineage()
    run = lambda **k: ingest.step(s, say(**k))[:2]
    assert run() == ("accepted", "Ok") and run() == ("duplicate", "FencedDuplicateContent") and run(content="d") == ("rejected", "FencedSequence")
    assert run(sequence=2, generation=4) == ("rejected", "FencedStaleGeneration") and run(sequence=2, epoch=1) == ("rejected", "FencedStaleEpoch")
    assert run(sequence=2, generation=2_000_000) == ("rejected", "OutOfRange") and run(sequence=2, high=6) == ("rejected", "FencedStaleGeneration")
    assert run(incarnation="b") == ("accepted", "Ok") and run(sequence=9) == ("rejected", "FencedIncarnation")
    assert run(incarnation="b", sequence=2, revisions=[5]) == ("accepted", "Ok") and run(incarnation="b", sequence=3, revisions=[4]) == ("fenced", "FencedRevision")
    assert run(incarnation="b", sequence=3, scope=["port.state"]) == ("fenced", "FencedAuthority")
    some = {"incarnation": "b", "subjects": ["x", "x", "y"], "aspects": ["link.state", "port.state", "my.own"], "revisions": [4, 0, 0]}
    assert ingest.step(s, say(sequence=3, **some), frozenset({"link.state", "port.state"})) == ("accepted", "Ok", ["FencedRevision", "", "Unsupported"])


OBSERVATION = "schema string, fabric string, source string, incarnation string, sequence long, generation long, epoch long, observed_at long, received_at long, arrival_seq long, recovered boolean, claims array<struct<subject:string,aspect:string,value:string,supported:boolean,revision:long>>"


def seen(source, sequence, *claims, n=None, schema="s/1", fabric="f", at=100):
    return (schema, fabric, source, "boot", sequence, 1, 1, at, 100, n or sequence, False, [(s, a, v, True, r) for s, a, v, r in claims])


def test_checks_that_need_no_order(spark):
    ok = ("d/1", "link.state", "up", 0)
    rows = [
        seen("a", 1, ok), seen("a", 0, ok, n=2), seen("", 3, ok), seen("a", 4, ok, ("d/1", "link.state", "down", 0)), seen("a", 5, ("", "link.state", "up", 0)), seen("a", 6, ok, schema="s/2"),
        seen("a", 7, ok, fabric="g"), seen("a", 8, ok, at=10**11), seen("a", 9, *[(f"d/{k}", "link.state", "up", 0) for k in range(513)]), seen("a", 10, schema=""), seen("a", 11), seen("b", 12, ok),
    ]
    known = spark.createDataFrame([("a",)], "source string")
    made = ingest.admit(spark.createDataFrame(rows, OBSERVATION).repartition(3), schema="s/1", fabric="f", registered=known).collect()
    want = ["Ok", "InvalidArgument", "InvalidArgument", "InvalidArgument", "InvalidArgument", "Unsupported", "FabricMismatch", "ClockInconsistent", "TooLarge", "InvalidArgument", "Ok", "SourceUnknown"]
    assert [r["code"] for r in sorted(made, key=lambda r: r["arrival_seq"])] == want


def test_a_partly_fenced_observation_end_to_end(spark):
    """Its fenced claim stays as evidence, asserts nothing, and is listed; a wholly fenced one is refused."""
    rows = [
        seen("a", 1, ("d/1", "link.state", "up", 5), ("d/1", "port.state", "on", 0)), seen("a", 2, ("d/1", "link.state", "down", 4), ("d/1", "port.state", "on", 0)), seen("a", 3, ("d/1", "link.state", "down", 3)),
        seen("a", 4, ("d/2", "my.own", "x", 0), ("d/2", "link.state", "up", 0)), seen("b", 5, ("d/1", "port.state", "on", 0)), seen("b", 5, ("d/1", "port.state", "on", 0), n=6),
    ]
    frame = spark.createDataFrame(rows, OBSERVATION)
    outcomes = ingest.admit(frame, spark.createDataFrame([("b", ["link.state"])], "source string, aspects array<string>"), known_only=True).cache()
    assert [(r["disposition"], r["code"], r["fences"]) for r in outcomes.orderBy("arrival_seq").collect()] == [
        ("accepted", "Ok", ["", ""]), ("accepted", "Ok", ["FencedRevision", ""]), ("fenced", "FencedRevision", ["FencedRevision"]), ("accepted", "Ok", ["Unsupported", ""]), ("fenced", "FencedAuthority", ["FencedAuthority"]), ("fenced", "FencedAuthority", ["FencedAuthority"]),
    ]
    claims = ingest.evidence(frame, outcomes)
    assert {(r["sequence"], r["aspect"], r["fence"]) for r in claims.where("fenced").collect()} == {(2, "link.state", "FencedRevision"), (4, "my.own", "Unsupported")}
    states = {(r["subject"], r["aspect"]): r for r in Snapshot(claims, Policy()).aspects.collect()}
    assert states["d/1", "port.state"]["truth"] == "known" and states["d/2", "link.state"]["agreed"] == "up"
    # the later claim is fenced, the earlier one superseded: nothing asserts the link's state
    assert states["d/1", "link.state"]["truth"] == "stale" and states["d/2", "my.own"]["truth"] == "stale"
    assert [(r["sequence"], r["fence"]) for r in ingest.rejections(frame, outcomes).orderBy("arrival_seq").collect()] == [(3, "FencedRevision"), (5, "FencedAuthority")]
    assert {(r["source"], r["sequence"], r["aspect"]) for r in ingest.fenced_claims(frame, outcomes).collect()} == {("a", 2, "link.state"), ("a", 3, "link.state"), ("a", 4, "my.own"), ("b", 5, "port.state")}
    assert ingest.rejections(frame, outcomes, 1).first()["sequence"] == 5
    assert tuple(ingest.counters(outcomes).first()) == (3, 0, 3, 0, 5)
    lines = explain.subject(Snapshot(claims, Policy()).aspects, Snapshot(claims, Policy()).retained, "d/1", None, ingest.rejections(frame, outcomes), ingest.fenced_claims(frame, outcomes)).collect()
    assert [r["line"] for r in lines if r["kind"] == "truth"] == ["stale"] and sum(r["kind"] == "fence" for r in lines) == 4 and sum(r["kind"] == "evidence" for r in lines) == 4


@pytest.fixture(scope="module")
def read_twice(spark):
    """Outcomes of observations, the same ones gathered from events in another order, and what is beyond a scope."""
    loaded = events.load(spark, SF)
    first, again = (events.batched(loaded.orderBy(by)) for by in (F.asc("event_id"), F.desc("event_id")))
    outcomes = ingest.admit(first, spark.createDataFrame([("source/s5", ["link.state", "failure.state"])], "source string, aspects array<string>")).cache()
    return again, outcomes, (F.col("source") == "source/s5") & ~F.col("aspect").isin("link.state", "failure.state")


def test_evidence_is_fenced_by_its_own_fence_in_whatever_order_events_are_read(read_twice):
    again, outcomes, beyond = read_twice
    kept = ingest.evidence(again, outcomes)
    assert kept.where("fenced").count() > 0 and kept.where(F.col("fenced") != beyond).isEmpty()


def test_fenced_claims_are_those_beyond_the_scope_in_whatever_order_events_are_read(read_twice):
    again, outcomes, beyond = read_twice
    taken = ingest.fenced_claims(again, outcomes, None)
    assert taken.count() == ingest.counters(outcomes).first()["claims_fenced"] > 0 and taken.where(~beyond).isEmpty()


def test_a_subject_without_evidence_is_unknown(spark):
    s = Snapshot(spark.createDataFrame([claim("a", "up")], CLAIM), Policy())
    assert [(r["kind"], r["line"].split(":")[0]) for r in explain.subject(s.aspects, s.retained, "device/zz").collect()] == [("truth", "unknown"), ("reason", "unknown")]
    known = [r for r in explain.subject(s.aspects, s.retained, "device/a", "link.state").collect() if r["kind"] == "reason"]
    assert len(known) == 1 and known[0]["line"].startswith("link.state: known: 1 fresh source(s) agree")


def test_causal_references_assert_no_cause(spark):
    rows = [("a" * 64, [("b" * 64, "temporally-precedes", "same link"), ("c" * 64, "caused-by", None)]), ("b" * 64, [])]
    made = {r["antecedent"][0]: r for r in explain.causality(spark.createDataFrame(rows, "observation_id string, causal array<struct<antecedent:string,strength:string,basis:string>>")).collect()}
    assert made["b"]["known"] and made["b"]["line"] == f"observation {'a' * 12} temporally-precedes observation {'b' * 12} (basis: same link); recorded temporal ordering only; no causal relationship is asserted"
    assert not made["c"]["known"] and made["c"]["strength"] == "correlates-with" and "(basis" not in made["c"]["line"]


def test_lineages_keep_the_last_boots(spark):
    rows = [claim("a", "up", sequence=k, incarnation=f"b{k:02}", generation=1 + k // 6, epoch=3 - k % 3, n=k) for k in range(1, 12)]
    r = ingest.lineages(spark.createDataFrame(rows, CLAIM)).first()
    assert (r["incarnation"], r["sequence"], r["generation"], r["epoch"]) == ("b11", 11, 2, 3) and r["boots"] == [f"b{k:02}" for k in range(4, 12)]


def test_content_is_injective(spark):
    rows = [("a", "b\u0001c", None), ("a\u0001b", "c", None), ("a", "b", ""), ("a", "b", None), ("a", "bc", None), ("ab", "c", None)]
    frame = spark.createDataFrame([seen("s", 1, (s, a, v, 0)) for s, a, v in rows], OBSERVATION)
    assert frame.select(ingest.content(frame).alias("d")).distinct().count() == len(rows)
    two = [seen("s", 1, ("d/1", "a.b", "x", 0), ("d/2", "a.b", "y", 0)), seen("s", 1, ("d/2", "a.b", "y", 0), ("d/1", "a.b", "x", 0))]
    assert spark.createDataFrame(two, OBSERVATION).select(ingest.content(frame).alias("d")).distinct().count() == 1


def test_eviction_drops_the_oldest(spark):
    claims = spark.createDataFrame([claim(f"s{k:02}", "up", at=1000 - k, n=k) for k in range(40)], CLAIM)
    assert ingest.evicted(claims, 40).count() == 40
    left = {r["source"] for r in ingest.evicted(claims, 39).collect()}
    assert left == {f"s{k:02}" for k in range(38)}


def test_equal_sequences_are_decided_by_content(spark):
    rows = [claim("a", v, n=k) for k, v in enumerate(("x", "z", "y"))]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, CLAIM).repartition(3)
        assert {r["value"] for r in Snapshot(frame, Policy()).records.where("not old_sequence").collect()} == {"z"}


def test_conflicts_are_among_retained_claims(spark):
    rows = [claim(f"s{k:02}", "up" if k < 35 else "down", sequence=100 - k, n=k) for k in range(40)]
    s = Snapshot(spark.createDataFrame(rows, CLAIM), Policy())
    assert compose.conflict_groups(s.retained).count() == 0 and s.aspects.first()["truth"] == "known"


def test_history_and_view(spark, tmp_path):
    frame = spark.createDataFrame([claim("a", "up", n=1), claim("b", "up", n=2), claim("a", "down", sequence=2, n=3)], CLAIM)
    for k in range(1, 4):
        frame.where(f"arrival_seq = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    places = str(tmp_path / "evidence"), str(tmp_path / "history")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(view.publisher(*places, Policy())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    kept = History(spark, places[1])
    entries = kept.entries().orderBy("index").collect()
    assert [r["index"] for r in entries] == [1, 2, 3] and kept.latest() == 3 and len({r["snapshot_id"] for r in entries}) == 3
    assert kept.find(entries[0]["snapshot_id"]).first()["truth"] == "known" and kept.at(3).first()["truth"] == "conflicting"
    assert [(r["truth_before"], r["truth"]) for r in kept.diff_latest().collect()] == [("known", "conflicting")] and kept.diff(kept.at(1), kept.at(1)).count() == 0
    short = History(spark, places[1], 2)
    assert short.entries().count() == 2
    for call in (lambda: short.at(1), lambda: kept.diff_latest(3), lambda: kept.find("snap:none"), History(spark, str(tmp_path / "none")).latest):
        with pytest.raises(NotFound):
            call()
    # a batch that runs twice counts once, and the snapshot that it leads to is the published one
    view.publisher(*places, Policy())(frame.where("arrival_seq = 1"), 0)
    assert kept.latest() == 3 and kept.at(3).first()["claims"] == 3 and [r["index"] for r in kept.newest(2).collect()] == [3, 2]


def test_digest_of_a_table(spark):
    rows = [("p", f"k{k % 7}", f"line {k}") for k in range(40)]
    digest = lambda r: digest_of(spark.createDataFrame(r, "part string, key string, line string").repartition(3)).first()[0]
    assert digest(rows) == digest(rows[::-1]) != digest(rows[1:]) and digest(rows[:1] + [("p", "k1", "line 0")]) != digest(rows[:2])


def test_a_digest_is_dealt_once(spark):
    made = digest_of(spark.createDataFrame([("p", "k", "l")], "part string, key string, line string"))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_walk_reads_its_nodes_a_fixed_number_of_times(spark):
    """However deep it goes: nodes are counted as they are made."""
    made = spark.sparkContext.accumulator(0)

    def name(n):
        made.add(1)
        return f"n{n:02}"

    node = F.udf(name, "string")
    nodes = spark.range(12).select(node("id").alias("node"), F.lit("device").alias("kind"), F.when(F.col("id") > 0, F.format_string("n%02d", F.col("id") - 1)).alias("parent"))
    assert {r["node"]: r["depth"] for r in hierarchy.walk(nodes).collect()} == {f"n{k:02}": k for k in range(12)}
    assert made.value <= 3 * 12


def test_walks_of_changed_tables_and_repeated_nodes(spark, tmp_path):
    at, shape = str(tmp_path / "nodes"), "node string, kind string, parent string"
    found = lambda: sorted((r["node"], r["depth"], r["path"]) for r in hierarchy.walk(spark.read.parquet(at)).collect())
    spark.createDataFrame([("a", "site", None), ("b", "pod", "a"), ("b", "pod", "a"), ("c", "rack", "b")], shape).write.parquet(at)
    assert found() == [("a", 0, "a"), ("b", 1, "a>b"), ("b", 1, "a>b"), ("c", 2, "a>b>c"), ("c", 2, "a>b>c")]
    spark.createDataFrame([("d", "pod", "gone"), ("e", "rack", "d"), ("x", "rack", "y"), ("y", "rack", "x")], shape).write.mode("overwrite").parquet(at)
    assert found() == [("d", 0, "d"), ("e", 1, "d>e")]


def test_walks_by_root_and_limit(spark):
    nodes = spark.createDataFrame([("a", "site", None), ("a/1", "pod", "a"), ("a/2", "pod", "a"), ("a/1/x", "rack", "a/1"), ("b", "site", None), ("c", "pod", "gone"), ("f", "fabric", None), ("r1", "rack", "r2"), ("r2", "rack", "r1")], "node string, kind string, parent string")
    names = lambda frame: [r["node"] for r in frame.orderBy("path").collect()]
    assert names(hierarchy.walk(nodes, root="a")) == ["a", "a/1", "a/1/x", "a/2"] and names(hierarchy.walk(nodes, root="a/1")) == []
    assert names(hierarchy.walk(nodes, limit=3)) == ["a", "a/1", "a/1/x"] and tuple(hierarchy.header(nodes, limit=3).first()) == (3, 2, 0, True)
    assert tuple(hierarchy.header(nodes, root="a", depth=1, limit=3).first()) == (3, 1, 1, True) and tuple(hierarchy.header(nodes, root="a", limit=4).first()) == (4, 2, 0, False)
    assert {r["node"] for r in hierarchy.unattached(nodes).collect()} == {"a", "b", "c"}
    assert {r["node"] for r in query.subtree(nodes, "a/1").collect()} == {"a/1", "a/1/x"}


def test_a_walk_is_planned_without_a_job(spark):
    tracker = spark.sparkContext.statusTracker()
    nodes = events.forest(spark, SF)
    spark.sparkContext.setJobGroup("planning", "")
    try:
        hierarchy.walk(nodes)
    finally:
        spark.sparkContext.setJobGroup("rest", "")
    assert not tracker.getJobIdsForGroup("planning")


def test_two_times_are_composed_at_once(spark):
    s = Snapshot(events.load(spark, SF), Policy(fresh=events.DAY, aging=3 * events.DAY))
    now = F.col("received_max")
    made = diff.refresh_changes(s.refreshed(now, now + 2 * events.DAY))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 4 and "Expand" not in plan
    later = Snapshot(s.claims, s.policy, now + 2 * events.DAY)
    plain = lambda f: sorted(map(str, f.collect()))
    assert plain(made) == plain(diff.aspect_changes(s.aspects, later.aspects))


def test_claims_at_two_times_are_in_small_tasks(spark):
    s = Snapshot(events.load(spark, SF), Policy(fresh=events.DAY, aging=3 * events.DAY))
    plan = s.refreshed(F.col("received_max"), F.col("received_max") + events.DAY)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(subject#\d+, aspect#\d+, source#\d+, incarnation#\d+, 96\)", plan)


def test_checksums_against_a_loop(spark):
    def loop(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    draw = random.Random(1)
    rows = [(k, None if k % 9 == 4 else draw.randbytes(draw.choice((0, 1, 3, 8, 100)))) for k in range(60)]
    got = {r["k"]: r["c"] for r in spark.createDataFrame(rows, "k int, raw binary").repartition(2).select("k", x.crc32c("raw").alias("c")).collect()}
    assert got == {k: None if raw is None else loop(raw) for k, raw in rows}


def test_stream_equals_batch(spark, tmp_path):
    frame = spark.createDataFrame(random_claims(7), CLAIM)
    for k in range(4):
        frame.where(f"arrival_seq div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    fences.admit(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["arrival_seq"], r["disposition"], r["code"]) for r in spark.read.parquet(out).collect()}
    assert got == {(r["arrival_seq"], r["disposition"], r["code"]) for r in ingest.fold(frame).collect()}


def test_lines_of_json(spark, tmp_path):
    good = '{"schema":"s/1","fabric":"f","source":"a","incarnation":"i","sequence":"1","generation":"1","observed_at":"5","claims":[{"subject":"device/d","aspect":"link.state","value":{"k":"text","v":"up"}},{"subject":"device/d","aspect":"port.state","value":{"k":"int","v":"3"}}],"metadata":[{"k":"a","v":"x"}]}'
    twice = good.replace('"metadata":[', '"metadata":[{"k":"a","v":"y"},')
    odd = good.replace('"k":"a","v":"x"', '"k":"A b","v":"x"')
    large = good.replace('"v":"x"', '"v":"' + "x" * 300 + '"')
    (tmp_path / "x.ndjson").write_text("\n".join(["# said", "  # said too", "", good, good.replace('"1","observed', '"x","observed'), good.replace('"sequence":"1"', '"sequence":"0"'), '{"schema":"s/1"}', "{", twice, odd, large]))
    read = ndjson.read(spark, str(tmp_path / "x.ndjson"))
    assert sorted(r["status"] for r in read.collect()) == ["InvalidArgument", "InvalidArgument", "InvalidArgument", "MalformedInput", "MalformedInput", "MalformedInput", "Ok", "TooLarge"]
    row = read.where("status = 'Ok'").first()
    assert (row["epoch"], row["claims"][0]["supported"], row["claims"][0]["revision"], row["metadata"]) == (0, True, 0, {"a": "x"})
    ndjson.lines(read.where("status = 'Ok'").drop("status")).write.text(str(tmp_path / "back"))
    with pytest.raises(Exception, match="a line of observations is refused: "):
        ndjson.read(spark, str(tmp_path / "x.ndjson"), fail=True).collect()
    (tmp_path / "one.json").write_text(good.replace(",", ",\n"))
    assert ndjson.read_one(spark, str(tmp_path / "one.json")).select("status", "source").collect() == [("Ok", "a")]
    # from lines to truth
    arrivals = ndjson.arrivals(read, F.lit(7))
    outcomes = ingest.admit(arrivals, fabric="f", schema="s/1")
    states = {r["aspect"]: (r["truth"], r["agreed"]) for r in Snapshot(ingest.evidence(arrivals, outcomes), Policy()).aspects.collect()}
    assert states == {"link.state": ("known", "s:2:up"), "port.state": ("known", "i:3")}


def test_filters_without_a_limit_return_all_subjects(spark):
    aspects = spark.range(5000).select(F.format_string("device/%05d", "id").alias("subject"), F.lit("link.state").alias("aspect"), F.lit("stale").alias("truth"))
    for wanted in (query.Filter(kind="device"), query.Filter(domains=("link",)), query.Filter(truths=("stale",)), query.Filter(aspect="link.state")):
        assert query.run(aspects, wanted).count() == 5000
        assert tuple(query.header(aspects, wanted).first()) == (5000, 5000, 5000, False)
    assert query.run(aspects, query.Filter(limit=4500)).count() == 4500
    assert tuple(query.header(aspects, query.Filter(limit=4500)).first()) == (4501, 4500, 4500, True)


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 4, 5, None])
def test_query_header_against_a_plain_scan(spark, limit):
    rows = [("a/1", "p.x", "known"), ("a/2", "q.x", "known"), ("a/2", "p.x", "stale"), ("b/1", "p.x", "known"), ("b/2", "p.x", "known"), ("b/2", "p.y", "known"), ("b/3", "q.x", "known"), ("b/4", "p.z", "known"), ("b/5", "q.z", "known"), ("c/1", "p.x", "known")]
    frame = spark.createDataFrame(rows, "subject string, aspect string, truth string").repartition(3)
    for kind in (None, "b", "z"):
        scanned = subjects = aspects = 0
        truncated = False
        for s in sorted({r[0] for r in rows}):
            scanned += 1
            if kind and not s.startswith(kind + "/"):
                continue
            if limit and subjects >= limit:  # 0 is no limit
                truncated = True
                break
            n = sum(r[0] == s and r[1][0] == "p" for r in rows)
            subjects, aspects = subjects + (n > 0), aspects + n
        wanted = query.Filter(kind=kind, domains=("p",), limit=limit)
        assert tuple(query.header(frame, wanted).first()) == (scanned, subjects, aspects, truncated)
        assert query.run(frame, wanted).count() == aspects


def test_walks_tell_what_is_below_their_depth(spark):
    nodes = spark.createDataFrame([(f"n{k:02}", "device", f"n{k - 1:02}" if k else None) for k in range(20)] + [("n17b", "device", "n16")], "node string, kind string, parent string")
    assert tuple(hierarchy.header(nodes, depth=1).first()) == (2, 1, 1, True)
    assert tuple(hierarchy.header(nodes).first()) == (17, 16, 2, True)
    assert tuple(hierarchy.header(nodes.where("node < 'n05'")).first()) == (5, 4, 0, False)
    found = query.subtree(nodes, "n10", 3)
    assert found.count() == 4 and tuple(hierarchy.limited(nodes, found, 3).first()) == (1, True)


def test_forest_has_every_rack_and_port(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    want = {"site": read("region").count(), "pod": read("nation").count(), "rack": read("customer").count(), "device": read("orders").count(), "port": read("lineitem").select("l_orderkey", "l_linenumber").distinct().count()}
    nodes = events.forest(spark, SF).cache()
    assert {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()} == want
    assert nodes.select("node").distinct().count() == sum(want.values()) == hierarchy.walk(nodes).count()


def test_absent_parents(spark):
    nodes = spark.createDataFrame([("rack/1", "rack", None), ("device/1", "device", "rack/1"), ("device/2", "device", "rack/2"), ("port/2/1", "port", "device/2")], "node string, kind string, parent string")
    assert {tuple(r) for r in hierarchy.roots(nodes).collect()} == {("rack/1", "rack", False), ("device/2", "device", True)}
    assert {(r["node"], r["depth"]) for r in hierarchy.walk(nodes, "device").collect()} == {("device/2", 0), ("port/2/1", 1)}


def test_declared_scopes_reach_the_fold_and_the_stream(spark, tmp_path):
    frame = spark.createDataFrame([claim(s, "up", sequence=n, aspect=a, n=n) for s in ("a", "b", "c") for n, a in enumerate(("link.state", "port.state", "path.state"), 1)], CLAIM)
    scopes = spark.createDataFrame([("a", ["link.state"]), ("a", ["port.state"]), ("b", [])], "source string, aspects array<string>")
    want = {(s, n, "fenced", "FencedAuthority") if (s, n) == ("a", 3) else (s, n, "accepted", "Ok") for s in "abc" for n in (1, 2, 3)}
    assert {tuple(r) for r in ingest.fold(frame, scopes=scopes).collect()} == want
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    fences.admit(stream, scopes).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want


def test_registered_query_meets_every_fence(spark):
    from provlake import catalogue

    codes = {r["code"] for r in catalogue.queries()["authority_outcomes"](spark, SF).select("code").distinct().collect()}
    assert codes == {"Ok", "FencedAuthority", "FencedIncarnation", "FencedRevision"}


def test_nested_values_and_their_lines(spark, tmp_path):
    of = lambda k, v=None: {"k": k, "v": v}
    deep = of("int", "1")
    for _ in range(7):
        deep = of("list", [deep])
    good = {
        "n": of("null"), "b:1": of("bool", True), "i:-5": of("int", "-5"), "u:18446744073709551615": of("uint", "18446744073709551615"), "r:-0.0": of("real", -0.0), "r:0.0": of("real", 0.0), "r:1.0E300": of("real", 1e300),
        's:9:a"b\n é{}': of("text", 'a"b\n é{}'), "s:0:": of("text", ""), "x:0aff": of("blob", "0aFF"), "l[]": of("list", []), "l[3:i:1,5:s:1:x]": of("list", [of("int", "1"), of("text", "x")]),
        "m{1:a=14:l[9:s:5:[1,2]],1:b=3:i:2}": of("map", [of("b", of("int", "2")), of("a", of("list", [of("text", "[1,2]")]))]), "l[37:l[31:l[25:l[19:l[13:l[8:l[3:i:1]]]]]]]": deep,
    }
    bad = [of("bool", "yes"), of("int", "5x"), of("int", str(2**63)), of("uint", "-1"), of("uint", str(2**64)), of("blob", "0a1"), of("text"), of("list", "x"), of("list", [of("int", "q")]), of("list", [deep]), of("map", [of("a", of("int", "1"))] * 2)]
    every = [*good.values(), *bad, of("odd", "1")]
    line = lambda n, v: json.dumps({"schema": "s", "fabric": "f", "source": "a", "incarnation": "i", "sequence": str(n), "generation": "1", "observed_at": "5", "claims": [{"subject": "device/d", "aspect": "link.state", "value": v}], "metadata": [of("a", "x")]})
    (tmp_path / "x.ndjson").write_text("\n".join(line(n, v) for n, v in enumerate(every, 1)))
    read = ndjson.read(spark, str(tmp_path / "x.ndjson")).cache()
    got = {r["sequence"]: (r["status"], r["claims"][0]["canonical"]) for r in read.collect()}
    assert [got[n] for n in sorted(got)] == [("Ok", c) for c in good] + [("MalformedInput", None)] * len(bad) + [("Unsupported", None)]
    ndjson.lines(read.where("status = 'Ok'").drop("status")).write.text(str(tmp_path / "back"))
    again = {r["sequence"]: (r["status"], r["claims"][0]["canonical"]) for r in ndjson.read(spark, str(tmp_path / "back")).collect()}
    assert again == {n: v for n, v in got.items() if v[0] == "Ok"}


def test_names_and_escapes(spark):
    rows = [(t,) for t in ("a.b-1_", "A@b:c", "a\n", "", None, "a" * 65, 'q"\\\n\t\x01é\x7f')]
    got = spark.createDataFrame(rows, "t string").select(x.identifier(F.col("t")), x.authority_name(F.col("t")), x.escaped(F.col("t")), x.number_of(("x", "a.b-1_"), F.col("t"))).collect()
    assert [r[0] for r in got] == [True] + [False] * 6 and [r[1] for r in got] == [True, True] + [False] * 5
    assert got[6][2] == '"q\\"\\\\\\n\\t\\x01é\\x7f"' and got[4][2] is None and [r[3] for r in got] == [1] + [None] * 6
    sums = spark.createDataFrame([(5, 1), (x.MAX, 1), (3, 2)], "n long, g int").groupBy("g").agg(x.saturating_sum(F.col("n")).alias("s"))
    assert {(r["g"], r["s"]) for r in sums.collect()} == {(1, x.MAX), (2, 3)}


def test_filters_from_json():
    made = query.Filter.from_json('{"kind": "device", "domains": ["link"], "truths": ["known", "stale"], "aspect": "link.state", "limit": "7", "other": 1}')
    assert made == query.Filter("device", ("link",), ("known", "stale"), "link.state", 7) and query.Filter.from_json({}) == query.Filter()
    for bad in ({"kind": "planet"}, {"domains": ["weather"]}, {"truths": ["true"]}):
        with pytest.raises(query.Unsupported):
            query.Filter.from_json(bad)
    for bad in ([], {"kind": 1}, {"domains": "link"}, {"truths": [1]}, {"limit": "-1"}, {"limit": True}, {"limit": 1.5}, {"aspect": []}):
        with pytest.raises(ValueError):
            query.Filter.from_json(bad)


def test_policies_are_checked_and_told_apart():
    good = Policy(coverage={"link.state": (2, 3)}).validated()
    assert good.digest() == Policy(coverage={"link.state": (2, 3)}).digest() != Policy().digest() and good.text().startswith("policy default r1 fresh=30000000000 aging=120000000000 skew=5000000000 recovered_as_fresh=no digest=")
    for bad in (Policy(name="A"), Policy(name=""), Policy(fresh=-1), Policy(fresh=2, aging=1), Policy(coverage={"a.b": (0, 1)}), Policy(default_coverage=(1, 9))):
        with pytest.raises(ValueError):
            bad.validated()


def test_a_fold_goes_on_from_lineages(spark):
    old = [claim("a", "up", sequence=k, n=k) for k in (1, 2, 3)] + [claim("a", "up", incarnation="j", sequence=1, n=4), claim("b", "up", sequence=5, generation=4, epoch=2, n=5)]
    before = spark.createDataFrame(old, CLAIM)
    held = ingest.evidence(before, ingest.admit(before))
    kept = ingest.lineages(held)
    row = {r["source"]: r for r in kept.collect()}["a"]
    assert (row["incarnation"], row["sequence"], row["records"], row["boots"]) == ("j", 3, 4, ["boot", "j"])
    new = [
        claim("a", "up", incarnation="j", sequence=3, n=10), claim("a", "up", incarnation="boot", sequence=9, n=11), claim("a", "up", incarnation="j", sequence=4, n=12), claim("a", "up", incarnation="k", sequence=1, n=13),
        claim("b", "up", sequence=5, generation=4, epoch=2, n=5), claim("b", "down", sequence=5, generation=4, epoch=2, n=15), claim("b", "up", sequence=6, generation=3, n=16), claim("b", "up", sequence=7, generation=4, epoch=1, n=17), claim("c", "up", n=18),
    ]
    got = {r["arrival_seq"]: r["code"] for r in ingest.admit(spark.createDataFrame(new, CLAIM), resumed=kept).collect()}
    assert got == {10: "FencedSequence", 11: "FencedIncarnation", 12: "Ok", 13: "Ok", 5: "FencedDuplicateContent", 15: "FencedSequence", 16: "FencedStaleGeneration", 17: "FencedStaleEpoch", 18: "Ok"}


def test_restarts_lookups_and_nested_rows(spark):
    frame = spark.createDataFrame([claim("a", "up", n=1), claim("b", "up", n=2)], CLAIM)
    s, later = Snapshot(frame, Policy(), restart_epoch=1, restart_count=1), Snapshot(frame, Policy(), restart_epoch=3, restart_count=3)
    assert tuple(diff.restarts(s.header(), later.header()).first()) == (True, 2) and tuple(diff.restarts(later.header(), s.header()).first()) == (True, 0)
    assert s.subject("device/none").count() == 0 and s.source("source/none").count() == 0
    lean = s.subjects(claims=False, conflicts=False).schema["aspects"].dataType.elementType.fieldNames()
    assert "claims" not in lean and "conflicts" not in lean and {"claims", "conflicts"} <= set(s.subjects().schema["aspects"].dataType.elementType.fieldNames())
    assert json.loads(results.as_json(s.header()).first()["value"])["restart_epoch"] == "1"


def test_canonical_order_of_observations(spark):
    claims, causal = [("b", "x", {"k": 1}), ("a", "y", {"k": 2}), ("a", "x", {"k": 3})], [("2", "s", "b"), ("1", "s", "c"), ("1", "s", "a")]
    rows = spark.createDataFrame([(claims, causal)], "claims array<struct<subject:string,aspect:string,value:map<string,int>>>, causal array<struct<antecedent:string,strength:string,basis:string>>")
    row = ingest.canonical(rows).first()
    assert [(c["subject"], c["aspect"]) for c in row["claims"]] == [("a", "x"), ("a", "y"), ("b", "x")] and [c["basis"] for c in row["causal"]] == ["a", "c", "b"]
