from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline as pipeline
from crosstally.llm import decontamination, quality, similar, simhash
from tests.llm.test_ops import DOCS, brute_fingerprint, water, words


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the output of every stage, as lists of rows."""
    d = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, step in pipeline.STAGES:
        new = pipeline.stage(step(spark, docs, d), name)
        out.append((name, docs.columns, docs.collect(), new.columns, new.collect()))
        docs = new
    return out


def ids(rows):
    return [r["doc_id"] for r in rows]


def test_columns(stages):
    assert [s[0] for s in stages] == ["quality_classifier", "near_dedup", "decontamination", "mixing", "sharding"]
    for _, before, _, after, _ in stages[:-1]:
        assert before == after
    assert stages[-1][3] == [*stages[-1][1], "row_number", "shard", "slot"]


def test_near_dedup(stages):
    """Texts are linked by fingerprints at most 4 bits apart, or by 80 % of their 5-word shingles."""
    _, _, before, _, after = stages[1]
    rows = sorted(before, key=lambda r: r["doc_id"])
    prints = [brute_fingerprint(r["text"]) for r in rows]
    pairs = brute_similar([r["text"] for r in rows])
    pairs += [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    label = list(range(len(rows)))
    for _ in rows:
        new = list(label)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert sorted(ids(after)) == [rows[k]["doc_id"] for k in sorted(set(label))]


def test_decontamination(spark, stages):
    _, _, before, _, after = stages[2]

    def grams(t):
        w = [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    items = [grams(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in before for own in [grams(r["text"])] if any(len(i & own) >= 0.8 * len(i) for i in items)}
    assert sorted(ids(after)) == sorted(set(ids(before)) - bad)


def test_mixing(stages):
    _, _, before, _, after = stages[3]
    size = {r["doc_id"]: len(words(r["text"])) for r in before}
    names = sorted({r["source"] for r in before})
    sizes = {s: sum(size[r["doc_id"]] for r in before if r["source"] == s) for s in names}
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    for s in names:
        most = max(size[r["doc_id"]] for r in before if r["source"] == s)
        assert abs(sum(size[r["doc_id"]] for r in after if r["source"] == s) - want[s]) <= most
    assert max(ids(after).count(i) for i in set(ids(after))) <= 3


def test_sharding(stages):
    _, _, before, _, after = stages[4]
    assert sorted(ids(before)) == sorted(ids(after))
    for k in range(16):
        slots = sorted(r["slot"] for r in after if r["shard"] == k)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(after) / 16) < 1


def test_quality_keeps(spark, stages):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    after = set(ids(stages[0][4]))
    good = [i for i, q in label.items() if q == 1]
    assert sum(i in after for i in good) >= 0.98 * len(good) and quality.GRAM == 4


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_every_stage_on_odd_tables(spark, tmp_path, kind):
    odd = [(None, None, None, None, None, None, None, None, None, None, None, None, None)] * 3 + [(1, "same text", "en", "a", 9, "s", 1, "x", 1, True, "w", "f", 1)] * 4 + [(2, "", "en", None, 0, "s", 1, "x", 1, True, "w", "f", 1), (3, "word " * 50_000, "en", "a", 1, "s", 1, "x", 1, True, "w", "f", 1)]
    rows = [] if kind == "empty" else odd
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path))
    assert got.columns[:13] == [c.split()[0] for c in DOCS.split(", ")] and got.count() <= 3 * len(rows)
    for _, step in pipeline.STAGES if rows else []:  # on the odd rows themselves
        out = step(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert out.columns[:13] == got.columns[:13]
        assert out.count() <= 3 * len(rows)


def test_rows_that_share_a_key_are_judged_by_their_own_texts(spark):
    say = lambda stem, n: " ".join(f"{stem}{k}" for k in range(n))
    item = say("item", 24)  # 20 shingles
    parts = [" ".join(item.split()[:14]), " ".join(item.split()[10:])]  # 10 of them each: together over 80 %
    for k in (None, 7):
        docs = spark.createDataFrame([(k, f"x {item} y"), (k, say("a", 30)), *[(k, f"{say('p', 9)} {p}") for p in parts]], "doc_id long, text string")
        kept = decontamination.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
        assert sorted(r["text"] for r in kept) == sorted([say("a", 30), *[f"{say('p', 9)} {p}" for p in parts]])
        rows = [(k, say("a", 30)), (k, say("b", 30)), (k, say("b", 30)), (9, say("b", 30)), (k, say("c", 30)), (3, say("c", 30))]
        left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        want = [(k, say("a", 30)), (7 if k else 9, say("b", 30)), (3, say("c", 30))]
        assert sorted((r["text"], r["doc_id"] or 0) for r in left) == sorted((t, i or 0) for i, t in want)


def brute_similar(texts):
    """Pairs of texts that share 80 % of their 5-word shingles."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t.lower())) else set() for t in texts]
    return [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("chunk", [1024, 5])  # 5: crowded buckets are dealt over parts
def test_near_dedup_drops_similarity_of_80_percent(spark, chunk, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    rng, texts = random.Random(4), []
    for k in range(12):
        base = [f"w{k}x{rng.randrange(10**6)}" for _ in range(150)]
        for n in (0, 1, 2, 2, 3, 3, 4, 6, 9):
            w = list(base)
            for at in rng.sample(range(150), n):
                w[at] = f"new{rng.randrange(10**9)}"
            texts.append(" ".join(w))
    prints, pairs = [brute_fingerprint(t) for t in texts], brute_similar(texts)
    far = [p for p in pairs if (prints[p[0]] ^ prints[p[1]]).bit_count() > 4]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in pairs + near:
            label[a] = label[b] = min(label[a], label[b])
    got = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(ids(got.collect())) == sorted(set(label)) and len(far) > 50
