"""Hand-written histories through the whole engine."""

import json

import pytest

from skein.engine import Engine
from skein.operators import checks, commit
from skein.sources import events as E
from skein.sources import log
from skein.streaming import runner


def event(record, when="2024-01-01T00:00:00Z", operation="upsert", event_id=None, corrects=None, mode=None, title="Orchid Phone OP16 256GB black", price=100.0, specs=None, **more):
    specs = {"storage_gb": 256, "color": "black"} if specs is None else specs
    payload = {
        "observation_id": record, "store": {"display_name": more.get("seller", "Shop")}, "sku": more.get("sku", f"S-{record}"), "observed_at": when, "product_url": "https://x.invalid/p",
        "product": {"name": title, "brand": "Orchid", "model": more.get("mpn"), "barcode": more.get("gtin"), "specifications": specs}, "offer": {"price": {"amount": price, "currency": "USD"}, "availabilityCode": "in_stock"},
    }
    row = {"source": "retailer_api", "operation": operation, "update_mode": mode, "event_id": event_id or f"e-{record}-{when}-{operation}", "corrects_listing_id": corrects, "payload": json.dumps(payload)}
    return tuple(row.get(c, "withdraw" if c == "null_semantics" else None) for c in E.COLUMNS)


def frame(spark, events):
    return spark.createDataFrame([(*e, i) for i, e in enumerate(events)], ",".join(f"{c} string" for c in E.COLUMNS) + ",seq bigint")


@pytest.fixture(scope="module")
def built(spark):
    events = [
        event("a"), event("b", seller="Other"),
        event("c", specs={"storage_gb": 512, "color": "black"}, title="Orchid Phone OP16 512GB black"),
        event("d", specs={}, title="Orchid Phone OP16"),  # which variant is open
        event("e", title="Zephyr Blender ZB900", specs={"color": "red"}),
        event("a", when="2023-01-01T00:00:00Z", price=1.0),  # late: history only
        event("b", seller="Other", operation="unavailable", when="2024-02-01T00:00:00Z"),
        event("a", event_id="same"), event("a", event_id="same", price=5.0), event("a", event_id="same"),  # first, conflict, duplicate
        event("z", operation="correct", corrects="c", when="2024-03-01T00:00:00Z"),  # c is really 256GB
        event("c", when="2024-04-01T00:00:00Z", specs={"storage_gb": 512}),  # cannot undo the correction
        ("retailer_api", None, "upsert", None, "odd", None, None, None, None, "withdraw", '{"wrapped": {"observationId": "q1"}}'),
    ]
    made = commit.catalog(frame(spark, events))
    return made, commit.tables(made["entities"])


def rows(df, key):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


def test_decisions(built):
    d = rows(built[1]["decision"], "source_record_id")
    assert d["a"]["decision"] == d["b"]["decision"] == d["c"]["decision"] == "MATCH"
    assert d["a"]["variant_id"] == d["b"]["variant_id"] == d["c"]["variant_id"]  # after the correction
    assert d["e"]["universal_product_id"] != d["a"]["universal_product_id"]
    assert d["d"]["universal_product_id"] == d["a"]["universal_product_id"]


def test_history(built):
    l = rows(built[1]["listing"], "source_record_id")
    assert [h["applied"] for h in l["a"]["history"]] == [True, False, True]
    assert l["b"]["lifecycle"] == "inactive" and l["a"]["lifecycle"] == "active"
    assert l["c"]["attributes"]["storage_gb"] == "256" and not l["c"]["history"][-1]["applied"]
    assert "z" not in l  # the correction belongs to c


def test_quarantine_leaves_the_listing_alone(built):
    q = {(r.source_record_id, r.reason) for r in built[0]["quarantine"].collect()}
    assert q == {("a", "event_id_payload_conflict"), ("q1", "no_adapter_for_schema")}
    assert rows(built[1]["decision"], "source_record_id")["a"]["decision"] == "MATCH"


def test_audit_and_observation_keep_what_was(built):
    moves = [r for r in built[1]["audit"].collect() if r.authority == "authoritative_correction"]
    assert len(moves) == 1 and moves[0].prior_variant != moves[0].new_variant
    seen = [r for r in built[1]["observation"].collect() if r.listing.endswith(":c:1")]
    assert len({r.variant for r in seen}) == 2


def test_offers(built):
    o = [r for r in built[1]["offer"].collect() if "a" in r.records]
    assert len(o) == 1 and o[0].price == 100.0 and o[0].comparability == "COMPARABLE"


def test_conformance(built):
    assert [r for r in checks.conformance(built[1]).collect() if r.violations] == []


def test_components_equal_one_group(spark, built):
    """Folding by component gives the partitions that folding all events in one group gives."""
    from skein.operators.fold import Component
    from skein.sources.policy import built_in, canonical_keys

    ready = built[0]["classified"].where("status = 'new' and reason is null").orderBy("seq").toArrow().to_pylist()
    whole = Component(built_in(), set(canonical_keys(built_in())))
    for e in ready:
        whole.apply(e)
    one = {frozenset(v["listings"]) for v in whole.variants.values()}
    assert one == {frozenset(r.listings) for r in built[1]["variant"].collect()}


def test_patch_and_null(spark):
    patch = event("p", when="2024-01-02T00:00:00Z", operation="patch", specs={"storage_gb": 512, "color": None}, title=None)
    made = commit.tables(commit.catalog(frame(spark, [event("p", title="Orchid Phone OP16"), patch]))["entities"])
    (l,) = made["listing"].collect()
    assert l.attributes == {"storage_gb": "512"} and l.title == "Orchid Phone OP16"


def test_copied_code_abstains(spark):
    two = [event("a", title="Pine P16 phone", gtin="4006381333931"), event("b", title="Pine P15 phone", gtin="4006381333931")]
    d = rows(commit.tables(commit.catalog(frame(spark, two))["entities"])["decision"], "source_record_id")
    assert d["b"]["decision"] == "REVIEW" and d["b"]["universal_product_id"] is None


def test_copied_code_abstains_read_only(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"))
    engine.ingest(frame(spark, [event("a", title="Pine P16 phone", gtin="4006381333931")]).select(E.COLUMNS))
    ask = lambda title: json.dumps({"title": title, "identifiers": {"gtin": "4006381333931"}})
    found, _ = engine.resolve(spark.createDataFrame([("other", ask("Pine P15 phone")), ("same", ask("Pine P16 phone")), ("plain", ask("a phone"))], "listing string, payload string"))
    got = {r.listing: r for r in found.collect()}
    assert (got["other"].decision, got["other"].product, got["other"].rule) == ("REVIEW", None, "copied code")
    assert [h.score for h in got["other"].hypotheses] == [0.5] and got["other"].hypotheses[0].variant is None
    assert got["same"].decision == "MATCH" and got["same"].confidence == 0.95 and got["plain"].decision == "MATCH"


def test_tokens_of_one_listing_are_one_root(spark, tmp_path):
    """A listing that names two model tokens makes them one family for requests too."""
    engine = Engine(spark, str(tmp_path / "log"))
    engine.ingest(frame(spark, [event("a", title="Orchid OP16 alias ZX77", specs={"storage_gb": 256})]).select(E.COLUMNS))
    found, _ = engine.resolve(spark.createDataFrame([("r", json.dumps({"title": "ZX77"}))], "listing string, payload string"))
    (r,) = found.collect()
    assert r.product is not None and r.n_candidates == 1


def test_two_products_become_one(spark):
    """A listing with strong evidence for two products unites them; the moved listing keeps an audit."""
    two = [event("a", title="Orchid AB100", mpn="AB100", specs={"storage_gb": 256}), event("b", title="Orchid CD200", mpn="CD200", specs={"storage_gb": 256}), event("c", title="Orchid AB100 CD200", specs={"storage_gb": 256})]
    made = commit.tables(commit.catalog(frame(spark, two))["entities"])
    assert {r.universal_product_id for r in made["decision"].collect()} == {made["product"].first().id} and made["product"].count() == 1
    assert [r.reason for r in made["audit"].collect()] == ["two products became one"]


def test_engine_replay_and_resolve(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"))
    events = frame(spark, [event("a", gtin="4006381333931"), event("c", specs={"storage_gb": 512, "color": "black"}, title="Orchid Phone OP16 512GB black")]).select(E.COLUMNS)
    assert engine.ingest(events)["accepted"] == 2
    again = engine.ingest(events)
    assert again["duplicates"] == 2 and again["stored"] == 0
    asked = spark.createDataFrame([("r1", json.dumps({"title": "Orchid Phone OP16", "identifiers": {"gtin": "4006381333931"}})), ("r2", json.dumps({"title": "Orchid Phone OP16"})), ("r3", json.dumps({"title": "Zephyr QuantumBlade 9000 Hyperdrive"}))], "listing string, payload string")
    found, offers = engine.resolve(asked)
    assert {r.listing: r.decision for r in found.collect()} == {"r1": "MATCH", "r2": "REVIEW", "r3": "NO_MATCH"}
    assert [r.listing for r in offers.collect()] == ["r1"]
    engine.export(str(tmp_path / "out"))
    assert {r.entity: r.n for r in spark.read.json(str(tmp_path / "out/stats")).collect()}["listing"] == 2
    assert engine.health()["events"] == 2


def test_arrival_order_is_kept(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"))
    events = [event("r", event_id=f"x{9 - i}", price=float(i), when="2024-01-01T00:00:00Z") for i in range(9)]
    engine.ingest(frame(spark, events).coalesce(1).select(E.COLUMNS))
    (o,) = engine.tables()["offer"].collect()
    assert o.price == 8.0  # equal clocks: the later arrival


def test_stream_restarts_without_repeats(spark, tmp_path):
    source, log_path = tmp_path / "in", str(tmp_path / "log")
    source.mkdir()
    payload = event("a")[-1]
    (source / "1.json").write_text(json.dumps({"source": "retailer_api", "event_id": "x", "payload": json.loads(payload)}) + "\n")
    engine = Engine(spark, log_path)
    for n in range(2):
        stream = spark.readStream.schema("value string").text(str(source))
        runner.start(runner.records(stream, "retailer_api"), engine, str(tmp_path / f"checkpoint{n}")).awaitTermination(120)
    assert spark.read.parquet(log_path).count() == 1


def test_transports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "b.json").write_text("[{\"id\": 3}]")
    (tmp_path / "c.csv").write_text('record_id,product_name\nr1,"Phone, ""big"""\n')
    assert sorted(r.record for r in E.read_json(spark, str(tmp_path / "*.json")).collect()) == ['{"id":1}', '{"id":2}', '{"id":3}']
    assert json.loads(E.read_csv(spark, str(tmp_path / "c.csv")).first().record) == {"record_id": "r1", "product_name": 'Phone, "big"'}
    good, bad = E.from_events(spark.createDataFrame([('{"event_id": "1", "payload": {"a": 1}}',), ('{"event_id": "2"}',)], "record string"))
    assert good.count() == 1 and bad.count() == 1


def test_ingest_counts_like_the_whole_log(spark, tmp_path):
    """Batch by batch, counters are those of all deliveries at once, idempotency keys and conflicts included."""
    def keyed(e, key):
        return (*e[:E.COLUMNS.index("idempotency_key")], key, *e[E.COLUMNS.index("idempotency_key") + 1 :])

    batches = [
        [keyed(event("a", event_id="1"), "k"), event("b", event_id="2"), event("b", event_id="2")],
        [keyed(event("a", event_id="3"), "k"), event("b", event_id="2", price=7.0), event("c", event_id="4")],  # repeats by key, conflicts
        [keyed(event("a", event_id="5", price=8.0), "k"), keyed(event("a", event_id="6", price=8.0), "k"), event("c", event_id="4"), keyed(event("a", event_id="1"), "k")],
    ]
    engine = Engine(spark, str(tmp_path / "log"))
    got = [engine.ingest(frame(spark, b).coalesce(1).select(E.COLUMNS)) for b in batches]
    assert [(g["received"], g["accepted"], g["duplicates"], g["quarantined"], g["stored"]) for g in got] == [(3, 2, 1, 0, 2), (3, 1, 1, 1, 3), (4, 1, 3, 0, 2)]
    stored = log.classify(log.read(spark, engine.log_path)).groupBy("status").count().collect()
    assert dict(stored) == {"new": 4, "duplicate": 2, "conflict": 1}


def test_stored_keys_are_found_by_shuffle_too(spark):
    deliveries = spark.createDataFrame([("e1", "h1", "k", "r", 1), ("e2", "h2", "k", "r", 2), ("e3", "h3", None, "r", 3), ("e4", "h4", "  ", "r", 4)], "event_key string, payload_hash string, idempotency_key string, record_id string, seq long")
    batch = deliveries.where("event_key in ('e2', 'e4')")
    for most in (0, log.BROADCAST):
        assert {r.event_key for r in log.related(deliveries, batch, most).collect()} == {"e1", "e2", "e4"}


def test_healed_keeps_the_first_of_rows_stored_twice(spark):
    twice = frame(spark, [event("a", event_id="1"), event("a", event_id="1"), event("a", event_id="1", price=5.0)])
    assert sorted(r.seq for r in log.healed(twice).collect()) == [0, 2]
