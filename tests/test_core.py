from __future__ import annotations

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstally.functions import noise, optim
from crosstally.operators import aggregate as agg
from crosstally.operators import baseline_mrf, clean, dataset, dictionary, metrics, models, mrf, numbering, privacy, sampling, scoring
from crosstally.plans.grammar import Pair, QuerySet, parse_pairs
from crosstally.sources import datasets, staging, store


def counts():
    return {"displays": F.lit(1).cast("long"), "clicks": F.col("label").cast("long")}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.integers(0, 3, 600), rng.integers(0, 4, 600), rng.integers(0, 2, 600)
    b = np.where(rng.random(600) < 0.5, a, b)
    y = (rng.random(600) < 1 / (1 + np.exp(-(a - 1 + c)))).astype(int)
    return spark.createDataFrame([tuple(map(int, r)) for r in zip(a, b, c, y, range(600), strict=True)], "a int, b int, c int, label int, id int").repartition(3).cache()


@pytest.fixture(scope="module")
def small(rows):
    known = dictionary.fit(rows, ["a", "b", "c"])
    encoded = known.encode(rows)
    q = QuerySet.build(known.sizes)
    return agg.aggregate(encoded, q, counts()), q, encoded, known


def cells(df):
    return {(r["query"], r["cell"]): tuple(r)[2:] for r in df.collect()}


def test_grammar():
    f = ["a", "b", "c"]
    assert parse_pairs("*", f) == [] and parse_pairs("*&*", f) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert parse_pairs("b&*", f) == [("a", "b"), ("b", "c")] and parse_pairs("c&a|b&*", f) == [("a", "c"), ("a", "b"), ("b", "c")]
    assert parse_pairs("*&*&*", f) == parse_pairs("*&*", f) and parse_pairs("a&a", f) == []
    assert parse_pairs("hash_2&hash_10", ["hash_2", "hash_10"]) == [("hash_10", "hash_2")]
    with pytest.raises(ValueError):
        parse_pairs("a&z", f)


def test_query_set_sizes(spark):
    q = QuerySet.build({"a": 10, "b": 20}, "*&*", {"default": 50, "b": 8})
    assert q.sizes == {"a": 10, "b": 8} and q.named("a&b").hashed and q.named("a&b").size == 50 and q.total == 68
    with pytest.raises(ValueError):
        q.named("a&b").split(F.lit(1))


def test_aggregate_forms_agree(small, rows):
    table, q, encoded, _ = small
    want = cells(table)
    assert cells(agg.aggregate_sets(encoded, q, counts())) == want
    assert {k: tuple(map(int, v)) for k, v in cells(agg.aggregate_dense(encoded, q, counts())).items()} == want
    halves = [agg.aggregate(encoded.filter(p), q, counts()) for p in ("id < 200", "id >= 200")]
    assert cells(agg.merge(*halves)) == want
    for name in q.names:
        assert sum(v[0] for (n, _), v in want.items() if n == name) == 600
    assert all(0 <= v[1] <= v[0] for v in want.values())
    single = {k: v for k, v in want.items() if k[0] == "b"}
    assert cells(agg.marginalize(table, q.named("a&b"), "a")) == single


def test_pair_decode_is_inverse(small):
    _, q, encoded, _ = small
    p = q.named("a&b")
    first, second = p.split(p.cell({"a": F.col("a"), "b": F.col("b")}))
    assert encoded.filter((first != F.col("a")) | (second != F.col("b"))).count() == 0


def test_dictionary_unknown_and_nulls(spark):
    train = spark.createDataFrame([(0.1, "x"), (-3.0, None), (10.0, "y"), (2.0, "x")], "v double, s string")
    known = dictionary.fit(train, ["v", "s"])
    assert known.sizes == {"v": 5, "s": 3}
    got = known.encode(spark.createDataFrame([(2.0, "y"), (7.0, None), (None, "zz"), (-3.0, "x")], "v double, s string")).collect()
    assert [tuple(r) for r in got] == [(2, 1), (4, 2), (4, 2), (0, 0)]
    with pytest.raises(ValueError):
        known.encode(spark.createDataFrame([(1,)], "z int"))
    assert dictionary.fit(train.limit(0), ["v"]).sizes == {"v": 1}


def test_clean(spark):
    df = spark.createDataFrame([(0, 5.0, None), (None, -1e9, "t"), (4, 100.0, "u")], "n int, x double, s string")
    assert [tuple(r) for r in clean.fill_nulls(df).select("n", "s").collect()] == [(0, ""), (-1, "t"), (4, "u")]
    assert [r[0] for r in df.select(clean.log_bucket(F.col("x"), 0)).collect()] == [2, -100, 6]
    assert df.select(clean.log_bucket(F.lit(0.0))).first()[0] == -200
    centers = [float(c) for c in range(10, 110, 10)]
    values = [5.0, 10.0, 19.0, 79.0, 80.0, 89.9, 90.0, 90.1, 1e6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(clean.to_centroid(F.col("v"), centers)).collect()]
    assert got == [10.0, 20.0, 20.0, 80.0, 90.0, 90.0, 90.0, 100.0, 100.0]
    train, valid = clean.split_rows(spark.range(2000), 0.3, ["id"])
    assert train.count() + valid.count() == 2000 and abs(valid.count() - 600) < 80


def test_noise_laws(spark):
    u = lambda k: noise.keyed_uniform(f"s{k}", F.col("id"))
    x = np.array([r[0] for r in spark.range(20_000).select(noise.discrete_laplace(0.3, u(1), u(2))).collect()])
    assert abs(x.mean()) < 0.15 and abs(x.std() - noise.laplace_sigma(0.3)) < 0.15
    assert abs((x == 0).mean() - noise.laplace_pmf(0, 0.3)) < 0.01
    g = np.array([r[0] for r in spark.range(20_000).select(noise.gaussian(4.0, u(3), u(4))).collect()])
    assert abs(g.mean()) < 0.1 and abs(g.std() - 4) < 0.1


def test_noise_posterior_near_sum():
    sigma = 6.0
    law = lambda k: np.exp(-k * k / 2 / sigma**2)
    for prior in (20.0, 60.0):
        for shift in (-10.0, 0.0, 10.0):
            exact = noise.expected_by_sum(prior + shift, prior, law, sigma)
            assert abs(noise.expected_gauss_np(np.array([prior + shift]), np.array([prior]), sigma)[0] - exact) < 1.5


def test_private_tables(small):
    table, q, *_ = small
    got = privacy.make_private(table, q, 50.0, seed="t")
    assert got.count() == q.total
    assert cells(got) == cells(privacy.make_private(table.repartition(2), q, 50.0, seed="t"))
    assert cells(privacy.make_private(table, q, 50.0)) != cells(privacy.make_private(table, q, 50.0))
    assert min(r["displays"] for r in privacy.make_private(table, q, 1.0, clip=True).collect()) >= 0


def test_field_gradient_by_differences(spark, small):
    table, q, *_ = small
    model = mrf.start(spark, table, q, mrf.Params(exact=True, with_unknown=False, l2_mu=2.0, l2_theta=3.0))
    rng = np.random.default_rng(0)
    model.mu, model.theta = model.mu + 0.2 * rng.standard_normal(q.total), 0.3 * rng.standard_normal(q.total)
    g_mu, g_theta = mrf.gradient(model, *mrf.exact_numpy(model))
    for vector, g in ((model.mu, g_mu), (model.theta, g_theta)):
        for i in (0, 3, 9, 20, q.total - 6):
            kept, e = vector[i], 1e-5
            vector[i] = kept + e
            up = mrf.log_likelihood(model)
            vector[i] = kept - e
            down = mrf.log_likelihood(model)
            vector[i] = kept
            assert abs((up - down) / 2 / e + g[i]) < 1e-2 * max(1, abs(g[i]))


def test_exact_fit_and_gibbs_agree(spark, small):
    table, q, encoded, _ = small
    model = mrf.fit_exact(mrf.start(spark, table, q, mrf.Params(exact=True, with_unknown=False, l2_mu=0.5, l2_theta=0.5)), 60)
    d, c = mrf.exact_numpy(model)
    assert np.abs(mrf.gradient(model, d, c)[1]).max() < 1.0
    own = model.as_field()
    for negatives in (True, False):
        x, ids = np.zeros((20_000, 3), np.int64), np.arange(20_000)
        for k in range(12):
            x = sampling.gibbs_sweep(own, x, ids, 3, k, negatives) if k % 3 else sampling.blocked_sweep(own, x, ids, 3, k) if negatives else sampling.gibbs_sweep(own, x, ids, 3, k, False)
        w, p = sampling.weights(own, x, negatives)
        e = np.zeros(q.total)
        for cell in own.cells(x):
            e += np.bincount(cell, weights=w, minlength=q.total)
        assert np.abs(e / w.sum() - d / model.n).max() < 0.02
    scored = mrf.predict(encoded, model)
    assert metrics.nllh(scored, "label", "prediction").first()["nllh"] > 0.05
    assert metrics.auc(scored, "label", "prediction").first()["auc"] > 0.65


def test_samples_do_not_depend_on_layout(spark, small):
    _, q, *_ = small
    own = sampling.Field(q, np.linspace(-1, 1, q.total), np.zeros(q.total))
    start = sampling.independent(spark, q, {f: np.ones(q.sizes[f]) for f in q.features}, 500, 1, 4)
    one = {r["sample_id"]: r["x"] for r in sampling.sweep(start, own, 1, 0).collect()}
    two = {r["sample_id"]: r["x"] for r in sampling.sweep(start.repartition(2), own, 1, 0).collect()}
    assert one == two and len(one) == 500


def test_save_and_load(spark, small, tmp_path):
    table, q, _, known = small
    store.save_aggregate(f"{tmp_path}/a", table, q, known, {"law": "none"})
    back, q2, known2, law = store.load_aggregate(spark, f"{tmp_path}/a")
    assert cells(back) == cells(table) and q2.names == q.names and q2.offsets == q.offsets and known2.sizes == known.sizes and law == {"law": "none"}
    log = store.run_experiment(spark, f"{tmp_path}/e", mrf.start(spark, table, q, mrf.Params(n_samples=200, parts=2)), 1, 2, lambda m: {"size": m.queries.total})
    assert [x["iteration"] for x in log] == [1, 2]
    model = store.load_model(spark, f"{tmp_path}/e/model-2")
    assert model.iteration == 2 and model.samples.count() == 200 and isinstance(model.queries.named("a&b"), Pair)


def test_aggregate_logistic_matches_cells(small):
    table, q, encoded, _ = small
    model = models.fit_aggregate_logistic(table, encoded, q, 25, l2=0.1)
    got = agg.aggregate(model.predict(encoded), q, {"y": F.col("label").cast("double"), "p": F.col("prediction")}).collect()
    assert max(abs(r["y"] - r["p"]) for r in got) < 8


def test_lbfgs():
    a = np.diag([1.0, 10.0, 100.0])
    assert np.allclose(optim.lbfgs(lambda x: a @ x - 1, np.zeros(3), 60), [1, 0.1, 0.01], atol=1e-4)


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write("a\tb\tc\n1\t2\t3\n4\t\t6\n")
    assert sorted(map(tuple, datasets.delimited(spark, str(tmp_path / "t.tsv.gz"), ["a", "c"], "a int, b int, c int", sep="\t", partitions=2).collect())) == [(1, 3), (4, 6)]
    (tmp_path / "bank.csv").write_text("age;y\n30;yes\n?;no\n")
    assert [tuple(r) for r in datasets.bank_csv(spark, str(tmp_path / "bank.csv"), "age int, y string").collect()] == [(30, 1), (None, 0)]
    (tmp_path / "census.csv").write_text("39 , State-gov,  <=50K\n50, Private, >50K.\n")
    assert [tuple(r) for r in datasets.census_csv(spark, str(tmp_path / "census.csv"), "age int, w string, inc string").collect()] == [(39, "State-gov", 0), (50, "Private", 1)]
    (tmp_path / "test.csv").write_text("|1x3 Cross validator\n39, State-gov, <=50K.\n\nforty, Private, >50K.\n")
    assert sorted(map(tuple, datasets.census_csv(spark, str(tmp_path / "test.csv"), "age int, w string, inc string", test=True).collect()), key=str) == [(39, "State-gov", 0), (None, "Private", 1)]
    (tmp_path / "x.txt").write_text("p\nq\nr\n")
    x = datasets.numbered_lines(spark, str(tmp_path / "x.txt"))
    y = datasets.numbered_lines(spark, str(tmp_path / "x.txt")).withColumnsRenamed({"row": "n", "value": "other"})
    assert all(r["value"] == r["other"] for r in datasets.bind_columns(x, y, "row", "n").collect())


def test_registered_queries_run(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    for name in ("agg_hashed_pair", "ctr_buckets", "stream_aggregate", "mrf_fit", "random_projection"):
        assert names[name](spark, sf_dir).count() > 0


def scans(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan parquet")


def test_source_is_scanned_once(spark, sf_dir):
    from crosstally.plans import catalogue

    for name in ("agg_all_pairs", "nb_predict", "agg_l1"):
        df = catalogue.queries()[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert 1 <= sum("lineitem.parquet" in line for line in plan.split("\n") if "FileScan" in line) <= 2, name


def test_dictionaries_by_ranges_are_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(float(k % 7) - 3, f"s{k % 11}", None if k % 3 else k) for k in range(200)] + [(float("nan"), None, None), (float("inf"), "é", 5)], "v double, s string, n int")
    here = dictionary.fit(rows, ["v", "s", "n"])
    monkeypatch.setattr(dictionary, "MAX_LOCAL", 0)
    ranged = dictionary.fit(rows, ["v", "s", "n"])
    assert sorted(map(tuple, here.table.collect())) == sorted(map(tuple, ranged.table.collect())) and here.sizes == ranged.sizes
    assert here.sizes["v"] == 10 and max(r["id"] for r in here.of("v").collect()) == 8
    assert [r["value"] for r in here.of("v").orderBy("id").collect()][:2] == [-3.0, -2.0]


def test_number_rows(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, "x") for k in range(1000)] + [(None, "y")], "k int, _salt string")
    numbered, n = numbering.number_rows(df, [F.col("k")], "at")
    got = sorted((r["at"], r["k"]) for r in numbered.collect())
    assert n == 1001 and got == [(0, None), *[(k + 1, k) for k in range(1000)]] and numbered.columns == ["k", "_salt", "at"]
    empty, none = numbering.number_rows(df.limit(0), [F.col("k")], "at")
    assert none == 0 and empty.count() == 0


def test_rate_buckets_against_a_plain_count(spark):
    rng = np.random.default_rng(1)
    rows = [(int(v), int(rng.random() < 0.1 + v / 200)) for v in rng.zipf(1.5, 4000) % 80]
    got = {r["value"]: r for r in dictionary.rate_buckets(spark.createDataFrame(rows, "v int, y int"), "v", F.col("y")).collect()}
    d, c = {}, {}
    for v, y in rows:
        d[v], c[v] = d.get(v, 0) + 1, c.get(v, 0) + y
    prior, edges, e = sum(c.values()) / len(rows), [], 2.0
    while e < max(c.values()) * 10:
        edges.append(e)
        e += e**0.5 + 1
    place = {v: (10 ** len(str(d[v])), sum(x <= (c[v] + prior) / (d[v] + 1) * 10 ** len(str(d[v])) for x in edges)) for v in d}
    ids = {p: k for k, p in enumerate(sorted(set(place.values())))}
    assert {v: (r["rounded"], r["bucket"], r["id"]) for v, r in got.items()} == {v: (*p, ids[p]) for v, p in place.items()}


def test_from_rows(spark, rows, small, tmp_path):
    want = cells(small[0])
    data = dataset.from_rows(rows, ["a", "b", "c"], others={"ids": F.col("id").cast("long")})
    assert {k: v[:2] for k, v in cells(data.table).items()} == want and data.law is None
    assert data.totals().first()["displays"] == 600 and data.of("a&b").agg(F.sum("displays")).first()[0] == 600
    with pytest.raises(KeyError):
        data.of("a&z")
    few = dataset.from_rows(rows, ["a", "b", "c"], "b&*", caps={"a&b": 5})
    assert few.queries.names == ["a", "b", "c", "a&b", "b&c"] and few.queries.named("a&b").hashed
    noisy = dataset.from_rows(rows, ["a", "b", "c"], epsilon=5.0, delta=1e-5, clip=True, seed="t")
    assert noisy.law["law"] == "gauss" and noisy.table.count() == noisy.queries.total and noisy.table.agg(F.min("clicks")).first()[0] >= 0
    assert dataset.from_rows(rows.limit(0), ["a"]).table.count() == 0
    noisy.save(f"{tmp_path}/noisy")
    back = dataset.load(spark, f"{tmp_path}/noisy")
    assert cells(back.table) == cells(noisy.table) and back.law == noisy.law and back.queries.names == noisy.queries.names
    assert back.encode(rows).count() == 600


def test_sixty_five_queries_by_grouping_sets(spark):
    names = [f"f{k}" for k in range(11)]
    df = spark.createDataFrame([tuple((j * (k + 3)) % (k % 3 + 2) for k in range(11)) + (j % 2,) for j in range(50)], ", ".join(f"{n} int" for n in names) + ", label int")
    data = dataset.from_rows(df, names)
    assert len(data.queries.queries) == 66
    assert cells(agg.aggregate_sets(data.encode(df), data.queries, counts())) == cells(data.table)


def test_outer_product_and_imports(spark, small):
    table, q, _, known = small
    product = agg.outer_product(table, q.named("a&b"), "displays")
    assert product.agg(F.sum("product")).first()[0] == 600 * 600
    published = spark.createDataFrame([(0, "x", 5, 1), (1, "y", 7, 2), (9, "z", 1, 1)], "feature_1_id int, feature_1_value string, count long, nb_clicks long")
    assert sorted(map(tuple, agg.import_singles(published, {0: "a", 1: "b"}).collect())) == [("a", "x", 5, 1), ("b", "y", 7, 2)]


def test_table_score_is_vector_score(spark, small):
    _, q, encoded, _ = small
    w = np.linspace(-1, 1, q.total)
    scored = encoded.withColumn("k", scoring.row_params(q)).withColumn("s", scoring.vector_score(F.col("k"), w))
    table = spark.createDataFrame([(k, float(v)) for k, v in enumerate(w)], "param long, value double")
    other = {r["id"]: r["score"] for r in scoring.table_score(scored, "id", "k", table).collect()}
    assert all(abs(other[r["id"]] - r["s"]) < 1e-9 for r in scored.select("id", "s").collect())


def exact_model(spark, small, **settings):
    table, q, *_ = small
    return mrf.start(spark, table, q, mrf.Params(with_unknown=False, l2_mu=1.0, l2_theta=1.0, **settings))


def test_fit_approaches_the_exact_optimum(spark, small):
    """Contrastive divergence, and the same steps on enumerated expectations, end near where L-BFGS ends."""
    best = mrf.log_likelihood(mrf.fit_exact(exact_model(spark, small, exact=True), 60))
    start = mrf.log_likelihood(exact_model(spark, small, exact=True))
    step = lambda n: mrf.log_likelihood(mrf.fit(exact_model(spark, small, exact=True), n))
    by_samples = mrf.log_likelihood(mrf.fit(exact_model(spark, small, n_samples=4000, parts=2), 12))
    assert best - step(2000) < 0.02 * (best - start) and abs(by_samples - step(12)) < 0.1 * (best - start)


def test_enumeration_is_refused_on_large_domains(spark):
    q = QuerySet.build({f"f{k}": 50 for k in range(6)}, "*")
    zero = np.zeros(q.total)
    model = mrf.Model(q, mrf.Params(exact=True), zero, zero, 1.0, 0.5, zero, zero, 0.0, 0.0, zero > -1)
    for call in (mrf.exact_numpy, mrf.log_likelihood, lambda m: mrf.states(spark, m.queries)):
        with pytest.raises(ValueError):
            call(model)


def test_averaged_expectations_and_mixing(spark, small):
    model = mrf.fit_exact(exact_model(spark, small, exact=True), 30)
    d, c = mrf.exact_numpy(model)
    own, q = model.as_field(), model.queries
    samples = sampling.independent(spark, q, {f: np.ones(own.choices(f)) for f in q.features}, 3000, 2, 2)
    for k in range(4):
        samples = sampling.sweep(samples, own, 3, k)
    samples = staging.stage(samples, "mixed")
    e, y = mrf.share(sampling.rao_blackwell(samples, own), model)
    assert np.abs(e / model.n - d / model.n).max() < 0.02 and np.abs(y / model.n - c / model.n).max() < 0.02
    got = {r["feature"]: r for r in sampling.mixing(samples, own, 4).collect()}
    assert set(got) == set(q.features) and all(abs(r["agreements"] - r["expected"]) < 0.05 * 3000 for r in got.values())
    same = sampling.mixing(samples, own, 0).collect()
    assert all(r["agreements"] == 3000 for r in same)
    x = sampling.to_driver(samples, 10)
    assert x.shape == (10, 3) and x[0].tolist() == samples.filter("sample_id = 0").first()["x"]
    y = sampling.label_draw(own, sampling.to_driver(samples), np.arange(3000), 5)
    assert abs(y.mean() - (1 / (1 + np.exp(-own.sums(sampling.to_driver(samples))[1]))).mean()) < 0.03


def test_block_step_moves_one_query_downhill(spark, small):
    model = exact_model(spark, small, exact=True)
    for clicks in (False, True):
        moved = mrf.block_step(model, "a&b", clicks, alpha=1.0, curvature=1.0)
        name, at = ("theta" if clicks else "mu"), model.queries.offsets["a&b"]
        changed = np.flatnonzero(getattr(moved, name) != getattr(model, name))
        assert changed.min() >= at and changed.max() < at + model.queries.named("a&b").size
        assert mrf.log_likelihood(moved) > mrf.log_likelihood(model)


def test_noise_laws_in_the_fit(spark, small):
    table, q, *_ = small
    sigma = noise.gauss_sigma(20.0, 1e-5, 12)
    noisy = staging.stage(privacy.make_private(table, q, 20.0, 1e-5, seed="t"), "noisy")
    for law in ("gauss", "gauss_beta"):
        model = mrf.start(spark, noisy, q, mrf.Params(exact=True, with_unknown=False, noise=law, noise_scale=sigma, n_samples=5000))
        d, c = mrf.exact_numpy(model)
        nd, _ = mrf.noise_part(model, d, c)
        true = np.zeros(q.total)
        for (name, cell), v in cells(table).items():
            true[q.offsets[name] + cell] = v[0]
        raw = scoring.scatter(noisy, q, "displays")
        assert np.square(raw - nd - true).mean() < 1.1 * np.square(raw - true).mean()
    assert noise.classic_gauss_sigma(1.0, 1e-5, 4) > noise.gauss_sigma(1.0, 1e-5, 4)
    a, trials, observed = np.array([30.0]), np.array([1000.0]), np.array([45.0])
    n = np.arange(0, 1001)
    from math import lgamma

    logs = np.array([lgamma(k + 300) + lgamma(1000 - k + 9700) - lgamma(k + 1) - lgamma(1001 - k) for k in n]) - np.square(45.0 - n) / 2 / 36
    assert abs(noise.expected_gauss_beta_np(observed, trials, a * 10, 10000 - a * 10, 6.0)[0] - (45.0 - n[np.argmax(logs)])) < 1.0


def test_noise_log_probability_prefers_the_right_scale(spark, small):
    values = {}
    for scale in (0.5, 30.0, 3000.0):
        model = exact_model(spark, small, n_samples=2000, parts=2, noise="gauss", noise_scale=scale)
        values[scale] = mrf.noise_log_probability(model)
    assert values[30.0] > values[0.5] and values[30.0] > values[3000.0]


def test_curve_area(spark):
    rows = [("q", k, float(100 - k), float(100 - k)) for k in range(50)] + [("q", 50, 0.0, 0.0), ("other", 0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "query string, cell int, y double, p double")
    alike = metrics.curve_area(table, "q", "y", "p", 20_000).first()
    assert abs(alike["area"] - alike["area_of_sampling"]) < 1e-12 and alike["area"] < 0.01
    flat = metrics.curve_area(table.withColumn("p", F.lit(1.0)), "q", "y", "p", 20_000).first()
    assert flat["area"] > 5 * flat["area_of_sampling"]
    drawn = metrics.resample(table, "q", "y", 20_000, "s").collect()
    assert sum(r["resampled"] for r in drawn) == 20_000 and all(abs(r["resampled"] - 20_000 * r["y"] / 3775) < 6 * (20_000 * r["y"] / 3775 + 1) ** 0.5 for r in drawn)


def test_chained_logistic_resumes(spark, small, tmp_path):
    table, q, encoded, _ = small
    model = models.fit_chained_logistic(spark, table, q, 1500, 15, path=f"{tmp_path}/chain")
    again = models.chained_samples(spark, table.limit(0), q, 1500, 5, path=f"{tmp_path}/chain")  # nothing left to fit
    assert again.count() == 1500 and len(again.first()["x"]) == 3
    scored = model.predict(encoded)
    assert metrics.auc(scored, "label", "prediction").first()["auc"] > 0.6
    store.save_logistic(spark, f"{tmp_path}/l", model)
    back = store.load_logistic(spark, f"{tmp_path}/l")
    assert np.array_equal(back.theta, model.theta) and back.bias == model.bias and back.queries.names == q.names


def test_baseline_variants_approach_the_tables(spark, small):
    table, q, encoded, _ = small
    base = np.zeros(q.total)
    with_p = agg.aggregate(encoded.withColumn("p0", F.lit(0.5)), q, counts() | {"p0": F.col("p0")})
    start = mrf.start(spark, with_p, q, mrf.Params(n_samples=2000, parts=2, l2_mu=1.0, l2_theta=1.0))
    model, field = baseline_mrf.fit_with_baseline(start, with_p, base, 0.0, 6)
    gap = lambda m: np.abs(mrf.predicted(m)[1] - m.clicks).mean()
    assert gap(mrf.replace(start, theta=model.theta, mu=model.mu)) < gap(start) and np.isfinite(field.nu).all()
    rows = baseline_mrf.with_row_samples(mrf.start(spark, table, q, mrf.Params(n_samples=10, l2_mu=1.0, l2_theta=1.0)), encoded, "id")
    fitted = baseline_mrf.fit_on_rows(rows, 5)
    assert gap(mrf.replace(fitted, samples=rows.samples)) < gap(rows)


def test_small_helpers(spark, rows, tmp_path):
    assert clean.numeric_columns(rows) == ["a", "b", "c", "label", "id"] and clean.with_ones(rows, "c1").first()["c1"] == 1
    assert [r["id"] for r in datasets.first_rows(rows, 3, "id").collect()] == [0, 1, 2]
    rows.write.parquet(f"{tmp_path}/t")
    assert datasets.Dataset(f"{tmp_path}/t", ("a", "b"), "label").read(spark).columns == ["a", "b", "label"]
    (tmp_path / "t.csv").write_text("a,b,label\n1,2,0\n")
    assert [tuple(r) for r in datasets.Dataset(f"{tmp_path}/t.csv", ("b",), "label", "csv").read(spark, "a int, b int, label int").collect()] == [(2, 0)]
    x = datasets.sample_matrix(spark, np.arange(12).reshape(6, 2), 2)
    assert x.count() == 6 and sampling.to_driver(x).tolist() == np.arange(12).reshape(6, 2).tolist()


def test_staging_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: {})  # noqa: RUF012
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        staging.shared_dir(Session())
    staged = staging.stage(spark.range(3), "x")
    staging.discard(staged, spark.range(1), None)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        staged.count()


def test_stream_goes_on_from_its_checkpoint(spark, rows, small, tmp_path):
    from crosstally.streaming import incremental

    table, q, _, known = small
    rows.filter("id < 300").coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: incremental.run_to_table(incremental.stream_aggregate(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), known, q, counts()), f"{tmp_path}/out")
    assert sum(v[0] for k, v in cells(run()).items() if k[0] == "a") == 300
    rows.filter("id >= 300").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert cells(run()) == cells(table)
    assert cells(run()) == cells(table)  # nothing new


def test_projection_brings_pairs_and_singles_together(small):
    _, q, *_ = small
    cells_ = np.random.default_rng(3).normal(0, 5, q.total)

    def gap(v):
        out, at = 0.0, q.offsets
        for p in (x for x in q.queries if isinstance(x, Pair)):
            table = v[at[p.name] : at[p.name] + p.size].reshape(q.sizes[p.second], q.sizes[p.first])
            out += np.abs(table.sum(axis=0) - v[at[p.first] : at[p.first] + q.sizes[p.first]]).sum()
            out += np.abs(table.sum(axis=1) - v[at[p.second] : at[p.second] + q.sizes[p.second]]).sum()
        return out

    assert gap(mrf.project(q, cells_)) < 0.1 * gap(cells_) and mrf.project(q, cells_, clip=True).min() >= 0
    even = mrf.project(q, cells_, 200)
    assert np.abs(mrf.project(q, even, 1) - even).max() < 1e-6  # what agrees stays


def test_poisson_loss_and_hessian(spark, small):
    model = exact_model(spark, small, exact=True)
    assert mrf.poisson_loss(model, np.maximum(model.displays, 1e-9), np.maximum(model.clicks, 1e-9)) < 1e-6
    fitted = mrf.fit(model, 30)
    assert mrf.poisson_loss(fitted, *mrf.predicted(fitted)) < mrf.poisson_loss(model, *mrf.predicted(model))
    d, c = mrf.exact_numpy(model)
    h_mu, h_theta = mrf.inverse_hessian(model, d, c)
    assert np.allclose(1 / h_mu, 2 + 0.5 * d + 0.5 * model.displays) and np.allclose(1 / h_theta, 2 + 0.5 * c + 0.5 * model.clicks)
