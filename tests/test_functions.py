import pytest
from pyspark.sql import functions as F

from skein.functions import identifiers, money, text, titles
from skein.sources import policy
from skein.sources.log import sniffed


def values(spark, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "t string").select(*cols).collect()]


def test_codes(spark):
    c = F.col("t")
    got = values(spark, ["00850000100011", "0085000010001?", "85000020011", "", None, "4006381333931"], identifiers.gtin_canonical(c), identifiers.gtin_validity(c))
    assert got == [("00850000100011", "checksum_invalid"), (None, "malformed"), ("00085000020011", "checksum_invalid"), (None, "missing"), (None, "missing"), ("04006381333931", "valid")]


def test_money_is_whole_or_nothing(spark):
    got = values(spark, ["USD twelve??", "$1,142.49", "429.99", "399.99 - 499.99", "12345 67", None], money.parse_money(F.col("t")))
    assert [g[0] for g in got] == [None, 1142.49, 429.99, None, None, None]


def test_tokens(spark):
    c = F.col("t")
    titles_ = ["Arc Series Two 41 mm wearable", "AeroRun Pegasus 41 AR41M-BW", "PinePhone 16", "Arc 2 inch", None]
    got = [set(g[0]) for g in values(spark, titles_, text.family_tokens(c))]
    assert got == [set(), {"PEGASUS41", "AR41"}, {"PINEPHONE16"}, set(), set()]
    assert [g[0] for g in values(spark, ["m2", "P16-256-BLK", "V12", "AL-XM6-B"], text.family(c))] == [None, "P16", "V12", None]
    assert values(spark, ["AL-XM6-B", "--"], text.squeeze(c)) == [("ALXM6B",), (None,)]
    assert values(spark, ["https://x.invalid/p/A?b=1", "https://x.invalid/", "no url"], text.sku_from_url(c))[:2] == [("A",), (None,)]
    assert values(spark, ["Solid State Zephyr drive"], text.fallback_tokens(c, F.lit("Ab"))) == [(["ZEPHYR"],)]


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("Phone 16GB 256GB Blk", {"storage_gb": "256", "color": "black"}), ("Disk 1024GB", {"storage_gb": "1000"}), ("Scent 1 fl oz gift set", {"volume_ml": "30", "bundle": "gift_set"}),
        ("Shoe men's US 10", {"size_us": "10", "department": "mens"}), ("Watch 41 mm", {"case_size_mm": "41"}), ("Console Digital 3-pack", {"edition": "digital", "bundle": "3_pack"}), ("Black and White tv 2025", {"color": "black", "generation": "2025"}),
        ("Book 8GB RAM", {"ram_gb": "8"}), ("", {}),
    ],
)
def test_titles(spark, title, expected):
    (row,) = values(spark, [title], titles.title_attributes(F.col("t"), F.lit("title")))
    assert {a["key"]: a["value"] for a in row[0]} == expected


def test_policy(spark):
    p = policy.built_in()
    assert len(policy.canonical_keys(p)) == 64 and len(p[policy.DEFAULT].dims) == 52
    for keys, title, name in [({"capacity_gb"}, "", "storage_devices"), (set(), "Noise headphone", "headphones"), ({"carrier"}, "phone", "phones"), ({"edition"}, "plain", "unknown"), (set(), None, "unknown")]:
        assert policy.inferred(keys, title) == name
        column = spark.range(1).select(policy.infer_category(F.array(*map(F.lit, sorted(keys))).cast("array<string>"), F.lit(title))).first()[0]
        assert column == name


def test_sniffed_ids():
    assert sniffed('{"envelope": {"data": {"recordId": "r9"}}}') == "r9"
    assert sniffed('{"listing-id": 7}') == "7"
    assert sniffed("[1]") is None and sniffed("no json") is None and sniffed(None) is None
