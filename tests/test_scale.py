"""Work that must not grow with the listings that share a key."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.operators import checks, commit, resolve
from skein.operators.evidence import title_evidence
from skein.operators.fold import Component
from skein.sources import log
from skein.sources.policy import built_in, canonical_keys
from tests.test_catalog import event, frame

GTINS = ["4006381333931", "5901234123457"]


@pytest.fixture(scope="module")
def made(spark):
    """Listings of one brand that share a model, codes and a seller's number, and move between variants."""
    events = []
    for i in range(90):
        title = f"Orchid Phone OP{16 + i % 2} {(128, 256, 512)[i % 3]}GB black"
        events.append(event(f"r{i % 60}", when=f"2024-01-01T00:{i // 60:02}:{i % 60:02}Z", title=title, gtin=GTINS[i % 2] if i % 5 == 0 else None, sku=f"S-{i % 7}", specs={"storage_gb": (128, 256, 512)[i % 3], "color": ("black", "red")[i % 2]}))
    events.append(event("z", operation="correct", corrects="r7", when="2024-03-01T00:00:00Z", title="Orchid Phone OP16 256GB"))
    return commit.catalog(frame(spark, events))


def test_an_index_counts_listings_by_what_they_are_assigned_to(made):
    state = Component(built_in(), set(canonical_keys(built_in())))
    for e in made["classified"].where("status = 'new' and reason is null").orderBy("seq").toArrow().to_pylist():
        state.apply(e)
        counted, families = {}, {}
        for l in state.listings.values():
            for k in state.resolved(l.keys()):
                counted.setdefault(k, Counter())[l.product if k[0] in ("code", "root") else (l.product, l.variant, l.configurable())] += 1
            for t in l.family if l.product else ():
                families.setdefault(l.product, Counter())[t] += 1
        assert counted == {k: c for k, c in state.index.items() if c} and families == {k: c for k, c in state.families.items() if c}
    assert len(state.listings) == 60 and max(map(len, state.index.values())) < 20


def test_extraction_is_dealt_over_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(log, "checkpointed", lambda df: seen.append(df.rdd.getNumPartitions()) or df)
    log.keyed(frame(spark, [event(f"r{i}") for i in range(20)]).coalesce(1))
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_conformance_reads_a_table_once_for_all_checks_of_its_rows(made):
    plan = checks.conformance(commit.tables(made["entities"]))._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") < 25


def test_a_token_that_all_share_makes_no_pairs(spark):
    """Requests of equal tokens, category and generation have their weak candidates in one row, not in one a pair."""
    none = "array<string>"
    asked = spark.range(300).selectExpr("id as listing", "'unknown' as category", "if(id % 2 = 0, '5', null) as generation", "map('size', '1') as dims", "'primary_product' as product_type", f"cast(array() as {none}) as family", f"cast(array() as {none}) as pin_keys", "if(id = 4, array('c7'), array()) as code_keys", "array('t') as token_keys")
    p = spark.range(200).selectExpr("concat('p', id) as product", "'unknown' as category", "cast(id as string) as generation", f"cast(array() as {none}) as family", "concat('c', id) as code", "'t' as token", "concat('v', id) as variant", "map('size', '1') as attrs")
    snap = {"products": p.select("product", "category", "generation", "family"), "pins": p.selectExpr("code as key", "product", "variant").limit(0), "codes": p.selectExpr("code as key", "product"), "tokens": p.selectExpr("token as key", "product")}
    strong, weak = resolve.candidates(asked, snap)
    assert (strong.count(), weak.count()) == (1, 2)
    got = {r.listing: r for r in resolve.decide(asked, strong, weak, p.select("product", "variant", "attrs")).collect()}
    assert len(got) == 300 and all(r.n_candidates == r.n_scored == 200 for r in got.values())
    assert (got[0].rule, got[0].product, got[0].variant) == ("fits", "p5", "v5") and (got[1].rule, len(got[1].hypotheses)) == ("weak tie", 200)
    assert got[4].rule == "fits" and got[4].product == "p5"  # the code's product is of another generation


def test_a_title_is_read_from_a_column(spark):
    """The title's own expression is worked out once a row and on all tasks, whatever the number of patterns."""
    title = F.concat(F.lit("red "), F.col("id").cast("string"), F.lit("GB 2 TB 30mm men's"))
    rows = title_evidence(spark.range(64, 68, 1, 1), title, F.lit("title"), "id")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("GB 2 TB 30mm") == 1 and rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.id, r.a.key, r.a.value) for r in rows.collect()} == {(i, k, v) for i in range(64, 68) for k, v in (("color", "red"), ("storage_gb", str(i)), ("storage_gb", "2000"), ("case_size_mm", "30"), ("department", "mens"))}
