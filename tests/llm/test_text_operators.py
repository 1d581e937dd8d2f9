"""Operators over texts against brute force, on small fixtures with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import common, language, mixing, packing, quality, secrets, sharding, simhash, suffix_dedup, tokens
from skein.llm.anchors import anchors
from skein.llm.automaton import Dfa
from skein.llm.suffixes import Family
from skein.llm.tokens import WordIds

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int, spans string, rk string, label int"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, i):
    w = text.split()
    w[i] = "edited"
    return " ".join(w)


BASE = prose(300, 1)
TEXTS = [
    BASE, BASE, edited(BASE, 150), prose(200, 2), prose(5000, 3), "", None, "   \n", "one", "two words", prose(50, 4) + " token = 'abcdef0123456789abcdef0123456789abcdef01' é", "Ünïcode " + prose(90, 6) + " " + BASE[:400],
    prose(60, 8) + " " + BASE[:400] + " tail", "AKIA" + "A" * 20 + " x", "<|endoftext|> " + prose(20, 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, 1, "clash", "clash", 2) for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "text without id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def hash_bits(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_masks_cover_every_pair():
    found = simhash.masks(4)
    assert len(found) == 31
    for seed in range(300):
        r = random.Random(seed)
        flip = sum(1 << b for b in r.sample(range(64), r.randrange(5)))
        assert any(not flip & m for m in found)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_simhash(spark, docs, bucket):
    got = simhash.near_duplicates(docs, bucket=bucket).collect()
    rows = docs.select("doc_id", "text").collect()
    fp = [hash_bits(r.text) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fp[i] ^ fp[j]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    least = {k: min((rows[i].doc_id for i in range(len(rows)) if label[i] == k and rows[i].doc_id is not None), default=None) for k in set(label)}
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(key, got)) == sorted(key((rows[i].doc_id, format(fp[i], "016x"), least[label[i]])) for i in range(len(rows)))


def test_similar_documents(docs):
    got = {r.doc_id: r for r in simhash.similar_documents(docs).where("doc_id is not null").collect()}
    assert got[2].component_id == got[1].component_id == 0 and got[3].component_id == 3
    assert [i for i, r in sorted(got.items()) if not r.kept] == [1, 2, 6, 7]  # 5 stands for the texts without words


def test_tokens_equal_whole_encoding():
    w = WordIds("word_bpe_49k.json", most=500)
    odd = ["Hi there's A <|endoftext|> x", "H̱ello ḧ. K", "a\x1cb c\x85d　e", "'Tis don't I'll, 3.5% 10,000...", "ſpecial İstanbul", "abc.'s x'. it's, a_b_ c__ d\\", "x≮ a≠ word≯", "", "　"]
    for s in odd + [t for t in TEXTS if t] * 2:
        assert np.frombuffer(w.ids(s.encode()), w.dtype).tolist() == w.encode(s, add_special_tokens=False).ids


def test_many_texts_share_few_calls_of_the_model(monkeypatch):
    """New words go to the model together, not text by text, and only once."""
    texts = [f"{prose(20, i)} {''.join(map(chr, [97 + i % 26, 233, 97 + i // 26]))}, É{prose(1, i)}. x{i} {i}.5%," for i in range(300)]
    texts += ["", " ", "  <|endoftext|> a", "H\u0331ello, İ. \u0130x!", "l'été's. Ünïcode", "\u3000a\u0085b", *texts[:5]]
    texts += [f"a{chr(c)}b, {chr(c)}." for c in range(0x250)]
    for by, most, new in ((len(texts), 1_000_000, tokens.NEW), (7, 50, 100)):
        monkeypatch.setattr(tokens, "NEW", new)
        w, sent = WordIds("word_bpe_49k.json", most), []
        for name in ("words", "batch", "encode"):
            monkeypatch.setattr(w, name, lambda x, f=getattr(w, name), **a: sent.append(x) or f(x, **a))
        got, n = [], []
        for lo in range(0, len(texts), by):
            ids, counts = w.many(pa.array(texts)[lo : lo + by], np.array([1], w.dtype).tobytes())
            got, n = got + ids.tolist(), n + counts.tolist()
        if by == len(texts):
            assert len(sent) <= 5
            del sent[:]
            w.many(pa.array(texts))
            assert sent == ["  <|endoftext|> a"]
        whole = [[*w.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert n == list(map(len, whole)) and got == sum(whole, [])


def test_runs_hold_every_string():
    for seed in range(50):
        r = random.Random(seed)
        strings = pa.array(["x" * r.choice([0, 1, 30, 500]) for _ in range(r.randrange(40))], pa.string())
        found = list(tokens.runs(strings, 200))
        assert [i for lo, hi in found for i in range(lo, hi)] == list(range(len(strings)))
        assert all(sum(len(strings[i].as_py()) + 16 for i in range(lo, hi - 1)) < 200 for lo, hi in found)


def test_plan_never_overuses():
    for seed in range(20):
        hist = np.random.default_rng(seed).integers(0, 60, 63)
        combos, repeats = packing.plan(hist)
        used = np.zeros(63, int)
        for c, x in zip(combos, repeats, strict=True):
            assert sum(c) == 64 and 2 <= len(c) <= packing.DEPTH
            for k in c:
                used[k - 1] += x
        assert (used <= hist).all()


def test_packing_round_trip(spark, docs, none):
    pieces = packing.pack(docs, window=64, quantum=8).collect()
    whole = WordIds("word_bpe_49k.json").encode
    wanted = sorted((str(r.doc_id), [*whole(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and p.length > 0
        by_doc.setdefault((str(p.doc_id), p.doc_tokens), []).append((p.start, ids))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    tokens = sorted((d, sum((i for _, i in sorted(v)), [])) for (d, _), v in by_doc.items() if d not in ("3", "None"))
    assert tokens == [w for w in wanted if w[0] not in ("3", "None")]
    assert sum(p.length for p in pieces) == sum(len(i) for _, i in wanted)
    for rows in by_sequence.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(sum(n for _, n in rows) < 64 for rows in by_sequence.values()) <= 1
    assert packing.pack(none).count() == 0


def lags(order, weights):
    """The largest distance of any source from its share of the first t slots, by the given weights."""
    shares, seen, most = mixing.exact(weights), dict.fromkeys(weights, 0), 0
    for t, s in enumerate(order, 1):
        seen[s] += 1
        most = max(most, *(abs(w * t - seen[x]) for x, w in shares.items()))
    return most


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 0.9999, "b": 0.0001}, {"a": 2**0.5, "b": 3**0.5, "c": 0.01, "d": 5**0.5}])
def test_pfair_lag_of_the_given_weights(weights):
    order = mixing.schedule(mixing.exact(weights), dict.fromkeys(weights, 20_000))
    assert len(order) >= 20_000 and lags(order, weights) < 1


def test_pfair_lag():
    for seed in range(150):
        r = random.Random(seed)
        weights = {f"s{i}": r.choice([r.random() + 0.001, Fraction(r.randrange(1, 9), 7), r.randrange(1, 5)]) for i in range(r.randrange(1, 9))}
        blocks = {s: r.randrange(1, 300) for s in weights}
        order = mixing.mixture(blocks, weights)
        assert {s: order.count(s) for s in weights} == blocks
        left = dict(blocks)
        while order:  # each part, up to the end of a source, keeps to the weights of the sources in it
            part = mixing.schedule(mixing.exact({s: weights[s] for s in left}), left)
            assert order[: len(part)] == part and lags(part, {s: weights[s] for s in left}) < 1
            order = order[len(part) :]
            left = {s: n - part.count(s) for s, n in left.items() if n > part.count(s)}


def test_plan_numbers_every_block():
    sizes = {"a": 1003, "b": 17, "c": 1}
    assert mixing.block_size(sizes, 16, 1 << 18) == 16 and mixing.block_size(sizes, 16, 10) == 128 and mixing.block_size(sizes, 16, 1) == 1024
    rows = mixing.plan(sizes, {"a": 5.0, "b": 1.0, "c": 1.0}, 16).to_pylist()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    at = 0
    for r in rows:
        assert r["first"] == at
        at += min(16, sizes[r["source"]] - 16 * r["block"])
    assert at == sum(sizes.values())


def test_mixing(docs, none):
    for block, slots in ((2, 1 << 18), (1, 3)):
        out = mixing.mix(docs, weights={"s0": 2.0, "s1": 1.0}, block=block, slots=slots).collect()
        assert sorted(r.position for r in out) == list(range(docs.count()))
        assert sorted(str((r.doc_id, r.text)) for r in out) == sorted(str((r.doc_id, r.text)) for r in docs.collect())
        assert [(r.slot, r.block, r.source) for r in sorted(out, key=lambda r: r.position)] == sorted((r.slot, r.block, r.source) for r in out)
    assert mixing.mix(none).count() == 0


def test_quality(spark, none):
    good = [(i, prose(40 + i % 30, i), "x") for i in range(120)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(40, i).split()), "x") for i in range(120, 160)]
    docs = spark.createDataFrame([*good, *bad, (900, None, "x"), (901, "", "x"), (901, "", "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(160) if i % 4] + [(3, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == 163 and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score >= quality.KEEP) == (r.doc_id < 120) for r in rows if r.doc_id < 160)
    assert quality.score(none, quality.train(none, labels), ["doc_id"]).count() == 0
    assert quality.train(docs, labels.where("quality = 1")).score(np.array([1])) > 0.9


def test_descent_reaches_the_optimum():
    """The primal value of the descent's weights equals the dual's, which projected gradient ascent finds."""
    r = np.random.default_rng(3)
    rows = [np.sort(r.choice(12, 4, replace=False)) for _ in range(40)]
    values, y = [r.normal(size=4) for _ in rows], np.where(r.random(40) < 0.7, 1.0, -1.0)
    w, bias = quality.descend(rows, values, y, 1.0, 2000)
    x = np.ones((40, 13))
    x[:, :12] = 0
    for i, (a, v) in enumerate(zip(rows, values, strict=True)):
        x[i, a] = v
    z, cost = x * y[:, None], np.where(y > 0, 1.0, max(1.0, (y > 0).sum() / (y < 0).sum()) ** 0.5)
    q, alpha = z @ z.T, np.zeros(40)
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
    got = np.append(w[:12], bias)
    primal, dual = got @ got / 2 + (cost * np.maximum(0, 1 - z @ got)).sum(), alpha.sum() - alpha @ q @ alpha / 2
    assert abs(primal - dual) < 1e-3 * dual


def test_language(spark, none):
    r = random.Random(1)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(40))
    rows = [(i, make("abcde") if i % 2 else make("vwxyé"), "aa" if i % 2 else "vv") for i in range(80)] + [(900, None, "aa"), (901, "12 .. ", None), (902, "", "vv")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = {x.doc_id: x for x in language.identify(docs, language.train(docs.where("doc_id < 60 or doc_id > 80")), ["doc_id"]).collect()}
    assert all(out[i].lang_pred == ("aa" if i % 2 else "vv") for i in range(80))
    assert {out[i].lang_pred for i in (900, 901, 902)} == {"und"} and out[901].score == 0
    assert language.train(none) is None and language.identify(docs, None, ["doc_id"]).where("lang_pred != 'und'").count() == 0


def test_language_slices(monkeypatch):
    for seed in range(60):
        r = random.Random(seed)
        t = "".join(r.choice("abÉ  \n.x1") for _ in range(r.randrange(1, 80)))
        monkeypatch.setattr(language, "SLICE", 1 << 18)
        whole = language.counts(t)
        monkeypatch.setattr(language, "SLICE", r.randrange(1, 9))
        part = language.counts(t)
        assert (whole is None and part is None) or (whole == part).all()


def found(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate((r.kind, re.compile(r.pattern.decode().replace("{12,}", "+").replace("{32,}", "+"), re.ASCII), r.group, r.least) for r in secrets.BASE):
        out += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_secrets_against_backtracking():
    parts = ["password", "Token", "SECRET", "apikey", "api_key", "=", ":", " ", '"', "'", "abcdefgh", "deadbeef", "0123456789abcdef", "AKIA", "ABCD1234", "é", "\n", "x.y-z/+=", "ſecret"]
    for seed in range(4000):
        r = random.Random(seed)
        t = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert [s for s in secrets.spans(t.encode()) if s[0] in {x.kind for x in secrets.BASE}] == found(t), t


def test_minimal_automaton():
    d = Dfa([b"(a|b)*abb"])
    assert len(d.rules) == 5  # four, and the one that other bytes lead to


def test_scan_and_mask(docs, none):
    out = secrets.scan(docs, ["doc_id", "text"]).withColumn("masked", secrets.masked(F.col("text"), F.col("spans"))).collect()
    assert len(out) == docs.count()
    for r in out:
        if not r.spans:
            assert r.masked == r.text
        else:
            assert secrets.spans(r.masked.encode()) == [] and "<secret>" in r.masked
    (hit,) = [r for r in out if r.doc_id == 10]
    assert hit.masked == hit.text[: hit.spans[0].start] + "<secret>" + hit.text[max(s.end for s in hit.spans) :]
    assert secrets.scan(none, ["doc_id"]).count() == 0


def test_sharding(docs, none):
    rows = sharding.assign(docs).collect()
    for r in rows:
        assert r.grown_shard in (r.shard, 8)
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows if r.doc_id is not None)
    assert sharding.assign(none).count() == 0


def test_the_shard_has_the_highest_score(spark):
    """Every score recomputed: Spark chains XXH64, the id's text first, then the shard as four bytes."""
    weights = [1.0, 2.0, 0.5, 1.0, 3.0]
    got = {r.id: r.s for r in spark.range(500).select("id", sharding.shard_of([F.col("id").cast("string")], weights).alias("s")).collect()}

    def score(id_, shard):
        seed = xxhash.xxh64_intdigest(str(id_).encode(), 42)
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11) + 0.5) / 2**53
        return -weights[shard] / math.log(u)

    assert got == {i: max(range(len(weights)), key=lambda s: (score(i, s), -s)) for i in range(500)}


def test_shares_follow_weights(spark):
    n = spark.range(20000).select(sharding.shard_of([F.col("id")], [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 20000 for r in n}
    assert abs(share[1] - 0.75) < 0.02


def test_anchors_depend_on_windows_only():
    r = random.Random(3)
    core = bytes(r.choice(b"abcd") for _ in range(300))
    places = []
    for _ in range(5):
        left = bytes(r.choice(b"abcd") for _ in range(r.randrange(300)))
        data = left + core + bytes(r.choice(b"abcd") for _ in range(200))
        p, _, a, b = anchors(data, 200)
        owner = {s: int(q) for q, x, y in zip(p, a, b, strict=True) for s in range(x, y + 1)}
        assert sorted(owner) == list(range(len(data) - 199))
        places.append([owner[len(left) + s] - len(left) for s in range(101)])
    assert all(x == places[0] for x in places)


def test_family():
    for seed in range(60):
        r = random.Random(seed)
        family, seen = Family(40), []
        for _ in range(r.randrange(1, 6)):
            base = bytes(r.choice(b"ab") for _ in range(150))
            new = [s for s in (base[r.randrange(60) :][: r.randrange(40, 90)] for _ in range(r.randrange(5))) if len(s) >= 40] + r.sample(seen, min(len(seen), 1))
            family.add(new, np.zeros(len(new), np.int64), np.array([len(s) - 40 for s in new], np.int64))
            seen += new
        windows = [s[i : i + 40] for s in seen for i in range(len(s) - 39)]
        assert family.matched().tolist() == [windows.count(w) > 1 for w in windows]


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_suffix_dedup(docs, none, group):
    out = suffix_dedup.deduplicate(docs, group=group, batch_bytes=2000).collect()
    texts = [(r.text or "").encode() for r in docs.collect()]
    count = {}
    for t in texts:
        for i in range(len(t) - 199):
            count[t[i : i + 200]] = count.get(t[i : i + 200], 0) + 1
    wanted = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        wanted.append((len(t), sum(gone), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    assert sorted((r.n_bytes, sum(x.e - x.s for x in r.removed), hashlib.sha256(r.kept).hexdigest()) for r in out) == sorted(wanted)
    assert suffix_dedup.deduplicate(none).count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark)
