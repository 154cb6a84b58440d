"""The catalogue of registered queries: name -> Spark callable, and its DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from math import exp, pi

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.functions import noise
from crosstally.operators import aggregate as agg
from crosstally.functions.optim import preconditioned_step
from crosstally.operators import baseline_mrf, clean, dataset, dictionary, metrics, models, mrf, privacy, sampling
from crosstally.operators.scoring import dense, scatter
from crosstally.plans.fixtures import CLICKS, ORDERS, PARTS, RETURNS, SMALL, WIDE, Fixture, pair_names
from crosstally.plans.grammar import QuerySet
from crosstally.sources.staging import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return put


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def counts() -> dict[str, Column]:
    return {"displays": F.lit(1).cast("long"), "clicks": F.col("label").cast("long")}


def table_of(spark: SparkSession, sf_dir: str, fixture: Fixture, spec: str = "*&*", caps: int | dict[str, int] | None = None) -> tuple[DataFrame, QuerySet, DataFrame, dictionary.Dictionaries]:
    rows = fixture.rows(spark, sf_dir)
    data = dataset.from_rows(rows, fixture.names(), spec, caps=caps)
    return data.table, data.queries, data.encode(rows), data.dictionaries


def cells(fixture: Fixture, names: list[str], measures: dict[str, str] | None = None, caps: dict[str, int] | int | None = None, where: str = "TRUE") -> str:
    return f"WITH {fixture.sql()}\n{fixture.agg_sql(names, measures, caps, where)}"


# ---- aggregation ----------------------------------------------------------------------------------------------------

RETURN_NAMES = RETURNS.names()
RETURN_PAIRS = pair_names(RETURN_NAMES)


@register("agg_single", cells(RETURNS, ["l_discount"]))
def agg_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, *_ = table_of(spark, sf_dir, Fixture(RETURNS.table, RETURNS.features[2:3], RETURNS.label, RETURNS.key), "*")
    return table


@register("agg_pair", cells(RETURNS, ["l_discount&l_tax"]))
def agg_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, *_ = table_of(spark, sf_dir, RETURNS, "l_tax&l_discount")
    return table.filter(F.col("query") == "l_discount&l_tax")


@register("agg_all_pairs", cells(RETURNS, [*RETURN_NAMES, *RETURN_PAIRS]))
def agg_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, RETURNS)[0]


WIDE_NAMES = WIDE.names()


@register("agg_wide", cells(WIDE, [*WIDE_NAMES, *pair_names(WIDE_NAMES)]))
def agg_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven features and all their pairs, 66 queries, in one plan."""
    return table_of(spark, sf_dir, WIDE)[0]


@register("agg_wide_sets", cells(WIDE, [*WIDE_NAMES, *pair_names(WIDE_NAMES)]))
def agg_wide_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by GROUPING SETS: more queries than one grouping id can tell apart."""
    encoded, known = WIDE.encoded(spark, sf_dir)
    return agg.aggregate_sets(encoded, WIDE.queries(known), counts())


@register("agg_orders", cells(ORDERS, [*ORDERS.names(), *pair_names(ORDERS.names())]))
def agg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, ORDERS)[0]


@register("agg_clicks", cells(CLICKS, [*CLICKS.names(), *pair_names(CLICKS.names())]))
def agg_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, CLICKS)[0]


@register("agg_cf_star", cells(RETURNS, [*RETURN_NAMES, *[p for p in RETURN_PAIRS if "l_tax" in p]]))
def agg_cf_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, RETURNS, "l_tax&*")[0]


@register("agg_cf_spec", cells(RETURNS, [*RETURN_NAMES, "l_linenumber&l_linestatus", *[p for p in RETURN_PAIRS if "l_discount" in p]]))
def agg_cf_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, RETURNS, "l_linestatus&l_linenumber|l_discount&*")[0]


@register("agg_grouping_sets", cells(RETURNS, [*RETURN_NAMES, *RETURN_PAIRS]))
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, known = RETURNS.encoded(spark, sf_dir)
    return agg.aggregate_sets(encoded, RETURNS.queries(known), counts())


@register("agg_dense", cells(RETURNS, [*RETURN_NAMES, *RETURN_PAIRS], {"displays": "CAST(count(*) AS DOUBLE)", "clicks": "CAST(sum(label) AS DOUBLE)"}))
def agg_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, known = RETURNS.encoded(spark, sf_dir)
    return agg.aggregate_dense(encoded, RETURNS.queries(known), counts())


THREE = {"displays": "count(*)", "clicks": "CAST(sum(label) AS BIGINT)", "ids": "CAST(sum(e.l_quantity) AS BIGINT)"}


@register("agg_multi_measure", cells(RETURNS, [*RETURN_NAMES, *RETURN_PAIRS], THREE))
def agg_multi_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, known = RETURNS.encoded(spark, sf_dir)
    return agg.aggregate(encoded, RETURNS.queries(known), counts() | {"ids": F.col("l_quantity").cast("long")})


@register("agg_merge_batches", cells(RETURNS, [*RETURN_NAMES, *RETURN_PAIRS]))
def agg_merge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves by key, aggregated apart and added up."""
    encoded, known = RETURNS.encoded(spark, sf_dir)
    half = clean.key_fraction(F.col("row_key")) < 0.5
    return agg.merge(*[agg.aggregate(encoded.filter(p), RETURNS.queries(known), counts()) for p in (half, ~half)])


HASH_CAPS = {"l_partkey": 500, "l_suppkey": 64, "default": 4000}


@register("agg_hashed_single", cells(PARTS, PARTS.names(), caps=HASH_CAPS))
def agg_hashed_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, PARTS, "*", HASH_CAPS)[0]


@register("agg_hashed_pair", cells(PARTS, pair_names(PARTS.names()), caps=HASH_CAPS))
def agg_hashed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, *_ = table_of(spark, sf_dir, PARTS, "*&*", HASH_CAPS)
    return table.filter(F.col("query").contains("&"))


@register("agg_totals", "SELECT count(*) AS displays, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS clicks FROM lineitem")
def agg_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, *_ = table_of(spark, sf_dir, RETURNS, "*")
    return agg.totals(table, q)


@register("agg_totals_median", "SELECT CAST(count(*) AS DOUBLE) AS displays, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS clicks FROM lineitem")
def agg_totals_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, *_ = table_of(spark, sf_dir, RETURNS, "*")
    return agg.median_totals(table, q)


PUBLISHED_SQL = """pub AS (
  SELECT 0 AS feature_1_id, 1 AS feature_2_id, l_linenumber AS feature_1_value, l_suppkey AS feature_2_value, count(*) AS count, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS nb_clicks
  FROM lineitem GROUP BY ALL)"""


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published pair table, as an outside party would hand it over."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(F.lit(0).alias("feature_1_id"), F.lit(1).alias("feature_2_id"), F.col("l_linenumber").alias("feature_1_value"), F.col("l_suppkey").alias("feature_2_value")).agg(
        F.count(F.lit(1)).alias("count"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("nb_clicks")
    )


@register("pair_orientations_union", f"WITH {PUBLISHED_SQL} SELECT feature_1_id, feature_2_id, CAST(feature_1_value AS BIGINT) AS feature_1_value, CAST(feature_2_value AS BIGINT) AS feature_2_value, count, nb_clicks FROM pub UNION ALL SELECT feature_2_id, feature_1_id, CAST(feature_2_value AS BIGINT), CAST(feature_1_value AS BIGINT), count, nb_clicks FROM pub")
def pair_orientations_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = published(spark, sf_dir).withColumn("feature_1_value", F.col("feature_1_value").cast("long"))
    return agg.both_orientations(p)


@register("reaggregate_import", f"""WITH {PUBLISHED_SQL},
ids AS (SELECT CAST(dense_rank() OVER (ORDER BY feature_1_value) - 1 AS INTEGER) AS a, CAST(dense_rank() OVER (ORDER BY feature_2_value) - 1 AS INTEGER) AS b, count, nb_clicks FROM pub),
sz AS (SELECT max(a) + 2 AS a, max(b) + 2 AS b FROM ids),
u AS (
  SELECT 'line' AS query, i.a % s.a AS cell, count, nb_clicks FROM ids i, sz s UNION ALL
  SELECT 'supp', i.b % least(s.b, 30), count, nb_clicks FROM ids i, sz s UNION ALL
  SELECT 'line&supp', CASE WHEN s.a * least(s.b, 30) > 100 THEN (i.a + 7907 * i.b) % 100 ELSE (i.a + s.a * i.b) % (s.a * least(s.b, 30)) END, count, nb_clicks FROM ids i, sz s)
SELECT query, CAST(cell AS INTEGER) AS cell, CAST(sum(count) AS BIGINT) AS count, CAST(sum(nb_clicks) AS BIGINT) AS nb_clicks, CAST(sum(578) AS DOUBLE) AS variance FROM u GROUP BY ALL""")
def reaggregate_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published pair table summed into the cells of a query set of our own, with the noise's variance per cell."""
    rows = published(spark, sf_dir).select(F.col("feature_1_value").alias("line"), F.col("feature_2_value").alias("supp"), "count", "nb_clicks")
    known = dictionary.fit(rows, ["line", "supp"])
    q = QuerySet.build(known.sizes, "*&*", {"supp": 30, "line&supp": 100})
    return agg.reaggregate(known.encode(rows), q, ["count", "nb_clicks"], variance=2 * 17.0**2)


@register("marginalize_pair", f"WITH {RETURNS.sql()} SELECT 'l_tax' AS query, CAST(l_tax AS INTEGER) AS cell, count(*) AS displays, CAST(sum(label) AS BIGINT) AS clicks FROM enc GROUP BY ALL")
def marginalize_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, *_ = table_of(spark, sf_dir, RETURNS, "l_tax&l_discount")
    return agg.marginalize(table, q.named("l_discount&l_tax"), "l_discount")


@register("decode_pair", f"WITH {RETURNS.sql()} SELECT CAST(e.l_discount + s.l_discount * e.l_tax AS INTEGER) AS cell, e.l_discount AS id_1, e.l_tax AS id_2, count(*) AS displays, CAST(sum(label) AS BIGINT) AS clicks FROM enc e, sz s GROUP BY ALL")
def decode_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, *_ = table_of(spark, sf_dir, RETURNS, "l_tax&l_discount")
    return agg.decoded(table, q.named("l_discount&l_tax"))


@register("outer_product", f"WITH {RETURNS.sql()}, d AS (SELECT l_discount AS i, count(*) AS n FROM enc GROUP BY ALL), t AS (SELECT l_tax AS j, count(*) AS m FROM enc GROUP BY ALL) SELECT 'l_discount&l_tax' AS query, CAST(i + s.l_discount * j AS INTEGER) AS cell, n * m AS product FROM d, t, sz s")
def outer_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, *_ = table_of(spark, sf_dir, RETURNS, "l_tax&l_discount")
    return agg.outer_product(table, q.named("l_discount&l_tax"), "displays")


@register("table_export", f"WITH {RETURNS.sql()} SELECT CAST(l_discount AS VARCHAR) AS l_discount, CAST(l_linestatus AS VARCHAR) AS l_linestatus, count(*) AS displays, CAST(sum(label) AS BIGINT) AS clicks FROM base GROUP BY ALL")
def table_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair's table with the values instead of ids."""
    table, q, _, known = table_of(spark, sf_dir, RETURNS, "l_discount&l_linestatus")
    rows = agg.decoded(table, q.named("l_discount&l_linestatus"))
    rows = known.decode(known.decode(rows, "l_discount", "id_1", "l_discount"), "l_linestatus", "id_2", "l_linestatus")
    return rows.select("l_discount", "l_linestatus", "displays", "clicks")


# ---- dictionaries and cleaning --------------------------------------------------------------------------------------

_DICT = "\nUNION ALL\n".join(f"SELECT DISTINCT '{n}' AS feature, CAST({n} AS VARCHAR) AS value, CAST(dense_rank() OVER (ORDER BY {n}) - 1 AS INTEGER) AS id FROM base" for n in RETURN_NAMES)


@register("dictionary", f"WITH {RETURNS.sql()}\n{_DICT}")
def dictionary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.fit(RETURNS.rows(spark, sf_dir), RETURN_NAMES).table


@register("encode", f"WITH {ORDERS.sql()} SELECT * FROM enc")
def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ORDERS.encoded(spark, sf_dir)[0]


@register("encode_unknown", "WITH d AS (SELECT DISTINCT c_nationkey AS v, CAST(dense_rank() OVER (ORDER BY c_nationkey) - 1 AS INTEGER) AS id FROM customer WHERE c_nationkey < 10) SELECT c_custkey, COALESCE(d.id, CAST((SELECT count(*) FROM d) AS INTEGER)) AS c_nationkey, COALESCE(CAST(d.v AS VARCHAR), '-1') AS value FROM customer LEFT JOIN d ON c_nationkey = d.v")
def encode_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that the dictionary hasn't seen get its last id, and '-1' on the way back."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    known = dictionary.fit(rows.filter("c_nationkey < 10"), ["c_nationkey"])
    return known.decode(known.encode(rows), "c_nationkey", "c_nationkey", "value")


@register("rare_grouping", "WITH k AS (SELECT l_partkey FROM lineitem WHERE l_linenumber < 5 GROUP BY l_partkey HAVING count(*) > 20) SELECT CAST(CASE WHEN k.l_partkey IS NULL THEN 0 ELSE l.l_partkey END AS BIGINT) AS l_partkey, count(*) AS n FROM lineitem l LEFT JOIN k ON l.l_partkey = k.l_partkey GROUP BY ALL")
def rare_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return dictionary.group_rare(rows, rows.filter("l_linenumber < 5"), "l_partkey").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


def _ctr_sql(totals: str) -> str:
    return f"""WITH RECURSIVE t AS ({totals}),
a AS (SELECT sum(c) / sum(d) AS prior, max(c) AS most FROM t),
edges(e) AS (SELECT CAST(2.0 AS DOUBLE) UNION ALL SELECT e + 1.0 * (sqrt(e) + 1.0) FROM edges, a WHERE e + (sqrt(e) + 1.0) < most * 10.0),
r AS (SELECT value, pow(10.0, 1.0 + floor(log10(d) + 1e-12)) AS rounded, (c + prior) / (d + 1) AS rate FROM t, a),
b AS (SELECT value, rounded, CAST((SELECT count(*) FROM edges, a WHERE e <= rate * rounded AND e < most * 10.0) AS INTEGER) AS bucket FROM r)
SELECT value, CAST(dense_rank() OVER (ORDER BY rounded, bucket) - 1 AS INTEGER) AS id, CAST(rounded AS BIGINT) AS rounded, bucket FROM b"""


@register("ctr_buckets", _ctr_sql("SELECT l_partkey AS value, CAST(count(*) AS DOUBLE) AS d, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS c FROM lineitem GROUP BY ALL"))
def ctr_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return dictionary.rate_buckets(rows, "l_partkey", (F.col("l_returnflag") == "R").cast("long"))


def _gauss_noise_sql(sigma: float, k: int) -> str:
    u = [f"((CAST(CAST('0x' || substr(md5('{j}|' || value), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0)" for j in (k, k + 1)]
    return f"{sigma!r} * sqrt(-2.0 * ln({u[0]})) * cos({2 * pi!r} * {u[1]})"


@register("ctr_buckets_noisy", _ctr_sql(f"SELECT value, greatest(d + {_gauss_noise_sql(3.0, 2)}, 1.0) AS d, greatest(c + {_gauss_noise_sql(3.0, 0)}, 0.0) AS c FROM (SELECT l_partkey AS value, CAST(count(*) AS DOUBLE) AS d, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS c FROM lineitem GROUP BY ALL)"))
def ctr_buckets_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    u = [noise.keyed_uniform(str(k), F.col("value")) for k in range(4)]
    return dictionary.rate_buckets(rows, "l_partkey", (F.col("l_returnflag") == "R").cast("long"), (noise.gaussian(3.0, u[0], u[1]), noise.gaussian(3.0, u[2], u[3])))


@register("null_fill", "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders) SELECT o_orderkey, COALESCE(o_custkey, (SELECT min(o_custkey) - 1 FROM x)) AS o_custkey, COALESCE(o_orderpriority, '') AS o_orderpriority FROM x")
def null_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return clean.fill_nulls(rows, ["o_custkey", "o_orderpriority"])


@register("log_bucket", "SELECT c_custkey, CAST(CASE WHEN c_acctbal = 0 THEN -200 WHEN c_acctbal + 500 <= 0 THEN -100 ELSE trunc(log2(CASE WHEN c_acctbal + 500 > 0 THEN c_acctbal + 500 ELSE 1 END)) END AS INTEGER) AS bucket FROM customer")
def log_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", clean.log_bucket(F.col("c_acctbal"), 500).cast("int").alias("bucket"))


_CENTERS = ", ".join(f"round_even(low + {i} * (high - low) / 10, 0) AS c{i - 1}" for i in range(1, 11))
_CENTER_CASE = "CASE WHEN v < c0 THEN c0 " + " ".join(f"WHEN v >= c{j} AND v < c{j + 1} THEN c{j + 1}" for j in range(7)) + " WHEN v >= c7 AND v <= c8 THEN c8 WHEN v > c8 THEN c9 END"


@register("centroid_bins", f"WITH m AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders), c AS (SELECT {_CENTERS} FROM m), x AS (SELECT o_totalprice AS v FROM orders) SELECT CAST({_CENTER_CASE} AS DOUBLE) AS centroid, count(*) AS n FROM x, c GROUP BY ALL")
def centroid_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.groupBy(clean.to_centroid(F.col("o_totalprice"), clean.centroids(rows, "o_totalprice")).alias("centroid")).agg(F.count(F.lit(1)).alias("n"))


_FRACTION = "CAST(CAST('0x' || substr(md5('0|' || {}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


@register("hash_split", f"SELECT o_orderkey, CASE WHEN {_FRACTION.format('o_orderkey')} < 0.3 THEN 'valid' ELSE 'train' END AS part FROM orders")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = clean.split_rows(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), 0.3, ["o_orderkey"])
    return train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))


@register("hash_sample", f"SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE {_FRACTION.format('o_orderkey')} < 0.1")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.sample_rows(spark.read.parquet(f"{sf_dir}/orders.parquet"), 0.1, ["o_orderkey"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@register("stable_hash", "SELECT c_custkey, CAST(CAST('0x' || substr(md5(c_name), 1, 8) AS BIGINT) % 1024 AS INTEGER) AS bucket FROM customer")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", clean.stable_hash(F.col("c_name"), 1024).alias("bucket"))


@register("temporal_split_agg", "WITH d AS (SELECT *, CAST(dense_rank() OVER (ORDER BY l_discount) - 1 AS INTEGER) AS cell FROM lineitem) SELECT 'l_discount' AS query, cell, count(*) AS displays, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS clicks FROM d WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL")
def temporal_split_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary over all rows, aggregate over those before a date: the filter reaches the scan."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_discount", "l_shipdate", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    known = dictionary.fit(rows, ["l_discount"])
    before, _ = clean.split_by_time(rows, "l_shipdate", "1997-01-01")
    return agg.aggregate(known.encode(before), QuerySet.build(known.sizes, "*"), counts())


@register("distinct_modalities", f"WITH {RETURNS.sql()} SELECT {', '.join(f'count(DISTINCT {n}) AS {n}' for n in RETURN_NAMES)} FROM base")
def distinct_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RETURNS.rows(spark, sf_dir).agg(*[F.count_distinct(n).alias(n) for n in RETURN_NAMES])


@register("clip_counts", "SELECT c_custkey, greatest(c_acctbal, 1.0) AS displays, greatest(c_acctbal, 0.0) AS clicks FROM customer")
def clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = clean.clip_counts(F.col("c_acctbal"), F.col("c_acctbal"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", d.alias("displays"), c.alias("clicks"))


@register("binned_comparison", "SELECT l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS label, round(sum(l_discount), 4) AS prediction, count(*) AS n FROM lineitem GROUP BY ALL")
def binned_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("label", (F.col("l_returnflag") == "R").cast("long"))
    return metrics.binned(rows, ["l_linenumber"], "label", "l_discount").withColumn("prediction", F.round("prediction", 4))


# ---- privacy --------------------------------------------------------------------------------------------------------

SMALL_NAMES = SMALL.names()
SMALL_QUERIES = [*SMALL_NAMES, *pair_names(SMALL_NAMES)]


def _dense_sql(fixture: Fixture, names: list[str]) -> str:
    every = "\nUNION ALL\n".join(f"SELECT '{q}' AS query, CAST(unnest(range(0, {fixture.cell_sql(q)[1]})) AS INTEGER) AS cell FROM sz s" for q in names)
    return f"WITH {fixture.sql()},\nagg AS ({fixture.agg_sql(names)}),\nevery AS ({every}),\ndense AS (SELECT query, cell, COALESCE(displays, 0) AS displays, COALESCE(clicks, 0) AS clicks FROM every LEFT JOIN agg USING (query, cell))"


def _uniform_sql(seed: str) -> str:
    return f"((CAST(CAST('0x' || substr(md5('{seed}|' || query || '|' || cell), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0)"


def _laplace_sql(measure: str, epsilon: float) -> str:
    return f"{measure} + CAST(floor(ln({_uniform_sql(f't|{measure}|1')}) / -{epsilon!r}) - floor(ln({_uniform_sql(f't|{measure}|2')}) / -{epsilon!r}) AS BIGINT)"


_EPS = noise.laplace_epsilon(6.0, 2 * len(SMALL_QUERIES))


@register("dp_laplace_keyed", f"{_dense_sql(SMALL, SMALL_QUERIES)} SELECT query, cell, {_laplace_sql('displays', _EPS)} AS displays, {_laplace_sql('clicks', _EPS)} AS clicks FROM dense")
def dp_laplace_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, *_ = table_of(spark, sf_dir, SMALL)
    return privacy.make_private(table, q, 6.0, seed="t")


@register("dp_clip", f"{_dense_sql(SMALL, SMALL_QUERIES)} SELECT query, cell, greatest({_laplace_sql('displays', _EPS)}, 0) AS displays, greatest({_laplace_sql('clicks', _EPS)}, 0) AS clicks FROM dense")
def dp_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, *_ = table_of(spark, sf_dir, SMALL)
    return privacy.make_private(table, q, 6.0, clip=True, seed="t")


_SIGMA = noise.gauss_sigma(6.0, 1e-5, 2 * len(SMALL_QUERIES))


def _gauss_sql(measure: str) -> str:
    return f"round({measure} + {_SIGMA!r} * sqrt(-2.0 * ln({_uniform_sql(f't|{measure}|1')})) * cos({2 * pi!r} * {_uniform_sql(f't|{measure}|2')}), 5) + 0.0"


@register("dp_gauss_keyed", f"{_dense_sql(SMALL, SMALL_QUERIES)} SELECT query, cell, {_gauss_sql('displays')} AS displays, {_gauss_sql('clicks')} AS clicks FROM dense")
def dp_gauss_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, *_ = table_of(spark, sf_dir, SMALL)
    noisy = privacy.make_private(table, q, 6.0, 1e-5, seed="t")
    return noisy.select("query", "cell", *[(F.round(m, 5) + F.lit(0.0)).alias(m) for m in ("displays", "clicks")])


_POSTERIOR = "WITH x AS (SELECT o_orderkey, o_totalprice / 1000.0 AS prior, o_totalprice / 1000.0 + (o_orderkey % 41 - 20) AS observed FROM orders)"


def _posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice") / 1000.0
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", p.alias("prior"), (p + (F.col("o_orderkey") % 41 - 20)).alias("observed"))


@register("noise_posterior_laplace", f"{_POSTERIOR}, y AS (SELECT *, prior * {exp(-0.1)!r} AS lo, prior * {exp(0.1)!r} AS hi FROM x) SELECT o_orderkey, round(CASE WHEN observed < lo THEN 0.95 * (lo - prior) + 0.05 * (observed - lo) WHEN observed > hi THEN 0.95 * (hi - prior) + 0.05 * (observed - hi) ELSE 0.95 * (observed - prior) END, 6) + 0.0 AS expected FROM y")
def noise_posterior_laplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posterior(spark, sf_dir).select("o_orderkey", (F.round(noise.expected_laplace(F.col("observed"), F.col("prior"), 0.1), 6) + F.lit(0.0)).alias("expected"))


_NEWTON = ",\n".join(f"s{k} AS (SELECT o_orderkey, observed, target, greatest(n - (n + 100.0 * ln(n) - target) / (1.0 + 100.0 / n), 0.0) + 0.01 AS n FROM s{k - 1})" for k in range(1, 11))


@register("noise_posterior_gauss", f"{_POSTERIOR}, s0 AS (SELECT o_orderkey, observed, observed + 100.0 * ln(prior + 0.001) AS target, greatest(observed, 0.0) + 0.01 AS n FROM x),\n{_NEWTON} SELECT o_orderkey, round(observed - n, 5) + 0.0 AS expected FROM s10")
def noise_posterior_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posterior(spark, sf_dir).select("o_orderkey", (F.round(noise.expected_gauss(F.col("observed"), F.col("prior"), 10.0), 5) + F.lit(0.0)).alias("expected"))


# ---- the field, with parameters that both engines can make ----------------------------------------------------------

L2, ALPHA, STEP, BIAS = 16.0, 0.5, 0.05, -0.7


def fixed_mu(param: Column) -> Column:
    return ((F.lit(17) * param) % 11 - 5) / F.lit(10.0)


def fixed_theta(param: Column) -> Column:
    return ((F.lit(13) * param) % 7 - 3) / F.lit(10.0)


FIXED_SQL = {"mu": "((17 * {}) % 11 - 5) / 10.0", "theta": "((13 * {}) % 7 - 3) / 10.0"}


def _params_sql(fixture: Fixture, names: list[str]) -> list[str]:
    """Each query's parameter index over a row e joined with sz s."""
    at, out = "0", []
    for q in names:
        cell, size = fixture.cell_sql(q)
        out.append(f"({at} + {cell})")
        at = f"{at} + {size}"
    return out


_FIELDS_SQL = f"""WITH {SMALL.sql()},
st AS (SELECT CAST(a AS INTEGER) AS l_linestatus, CAST(b AS INTEGER) AS l_linenumber, CAST(c AS INTEGER) AS l_discount FROM sz s, LATERAL (SELECT unnest(range(0, s.l_linestatus - 1)) AS a), LATERAL (SELECT unnest(range(0, s.l_linenumber - 1)) AS b), LATERAL (SELECT unnest(range(0, s.l_discount - 1)) AS c)),
k AS (SELECT row_number() OVER () AS state, [{', '.join(_params_sql(SMALL, SMALL_QUERIES))}] AS ps FROM st e, sz s),
kp AS (SELECT state, CAST(unnest(ps) AS BIGINT) AS param FROM k),
sc AS (SELECT state, sum({FIXED_SQL['mu'].format('param')}) AS m, sum({FIXED_SQL['theta'].format('param')}) + {BIAS} AS t FROM kp GROUP BY state),
w AS (SELECT state, exp(m) * (1 + exp(t)) AS w, 1 / (1 + exp(-t)) AS p FROM sc),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM enc),
ex AS (SELECT param, sum(w) / (SELECT sum(w) FROM w) * (SELECT n FROM tot) AS displays, sum(w * p) / (SELECT sum(w) FROM w) * (SELECT n FROM tot) AS clicks FROM kp JOIN w USING (state) GROUP BY param)"""

_DATA_SQL = f""",
obs AS (SELECT param, count(*) AS d, sum(label) AS c FROM (SELECT label, CAST(unnest([{', '.join(_params_sql(SMALL, SMALL_QUERIES))}]) AS BIGINT) AS param FROM enc e, sz s) GROUP BY param),
g AS (SELECT ex.param, ex.displays AS ed, ex.clicks AS ec, COALESCE(d, 0) AS d, COALESCE(c, 0) AS c, {FIXED_SQL['mu'].format('ex.param')} AS mu, {FIXED_SQL['theta'].format('ex.param')} AS theta FROM ex LEFT JOIN obs USING (param)),
gr AS (SELECT *, -d + ed + {2 * L2} * mu AS g_mu, -c + ec + {2 * L2} * theta AS g_theta FROM g)"""


def _small(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, QuerySet, DataFrame]:
    table, q, encoded, _ = table_of(spark, sf_dir, SMALL)
    return table, q, encoded


def _expected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, QuerySet]:
    table, q, encoded = _small(spark, sf_dir)
    n = float(encoded.count())
    return mrf.exact_expectation(spark, q, fixed_mu, fixed_theta, BIAS, n), table, q


@register("enum_states", f"{_FIELDS_SQL} SELECT l_linestatus, l_linenumber, l_discount FROM st")
def enum_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mrf.states(spark, _small(spark, sf_dir)[1])


@register("mrf_exact_expectation", f"{_FIELDS_SQL} SELECT param, round(displays, 5) AS displays, round(clicks, 5) AS clicks FROM ex")
def mrf_exact_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, *_ = _expected(spark, sf_dir)
    return expected.select("param", F.round("displays", 5).alias("displays"), F.round("clicks", 5).alias("clicks"))


def _fixed_vectors(q: QuerySet) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(q.total)
    return ((17 * i) % 11 - 5) / 10.0, ((13 * i) % 7 - 3) / 10.0


def _at_fixed(spark: SparkSession, sf_dir: str, **settings: object) -> tuple[mrf.Model, np.ndarray, np.ndarray]:
    """The field with the fixed parameters, fitted to the table's counts, and what it expects of them."""
    expected, table, q = _expected(spark, sf_dir)
    found = dense(expected, q.total, "displays", "clicks")
    displays, clicks = (scatter(table, q, m) for m in ("displays", "clicks"))
    mu, theta = _fixed_vectors(q)
    params = mrf.Params(exact=True, l2_mu=L2, l2_theta=L2, alpha=ALPHA, **settings)
    return mrf.Model(q, params, displays, clicks, 1.0, 0.5, mu, theta, BIAS, 0.0, np.ones(q.total, bool)), found["displays"], found["clicks"]


def _seen(spark: SparkSession, expected: np.ndarray, digits: int, **vectors: np.ndarray) -> DataFrame:
    """The parameters of cells that the enumerated states have."""
    rows = _parameters(spark, seen=expected, **vectors).filter("seen > 0")
    return rows.select("param", *[(F.round(v, digits) + F.lit(0.0)).alias(v) for v in vectors])


@register("mrf_gradient", f"{_FIELDS_SQL}{_DATA_SQL} SELECT param, round(g_mu, 5) + 0.0 AS g_mu, round(g_theta, 5) + 0.0 AS g_theta FROM gr")
def mrf_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, d, c = _at_fixed(spark, sf_dir)
    g_mu, g_theta = mrf.gradient(model, d, c)
    return _seen(spark, d, 5, g_mu=g_mu, g_theta=g_theta)


@register("mrf_modified_gradient", f"{_FIELDS_SQL}{_DATA_SQL} SELECT param, round(-c * least((ed + 1) / (d + 1), 1.0) + ec * least((d + 1) / (ed + 1), 1.0) + {2 * L2} * theta, 5) + 0.0 AS g_theta FROM gr")
def mrf_modified_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, d, c = _at_fixed(spark, sf_dir, modified_gradient=True)
    return _seen(spark, d, 5, g_theta=mrf.gradient(model, d, c)[1])


@register("mrf_precond_step", f"{_FIELDS_SQL}{_DATA_SQL} SELECT param, round(mu - {STEP} * greatest(-2.0, least(2.0, g_mu / ({2 * L2} + {ALPHA} * ed + {1 - ALPHA} * d))), 6) + 0.0 AS mu, round(theta - {STEP} * greatest(-2.0, least(2.0, g_theta / ({2 * L2} + {ALPHA} * ec + {1 - ALPHA} * c))), 6) + 0.0 AS theta FROM gr")
def mrf_precond_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, d, c = _at_fixed(spark, sf_dir)
    moved = [preconditioned_step(w, g, h, STEP) for w, g, h in zip((model.mu, model.theta), mrf.gradient(model, d, c), mrf.inverse_hessian(model, d, c), strict=True)]
    return _seen(spark, d, 6, mu=moved[0], theta=moved[1])


_BLOCK = SMALL_QUERIES[3]
_BLOCK_SQL = f"param >= (SELECT {' + '.join(SMALL.cell_sql(q)[1] for q in SMALL_QUERIES[:3])} FROM sz s) AND param < (SELECT {' + '.join(SMALL.cell_sql(q)[1] for q in SMALL_QUERIES[:4])} FROM sz s)"


@register("mrf_block_step", f"{_FIELDS_SQL}{_DATA_SQL} SELECT param, round(CASE WHEN {_BLOCK_SQL} THEN mu - 0.5 * g_mu / (200.0 + d + ed) ELSE mu END, 6) + 0.0 AS mu FROM gr")
def mrf_block_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step on the parameters of one pair alone."""
    model, d, c = _at_fixed(spark, sf_dir)
    return _seen(spark, d, 6, mu=mrf.block_step(model, _BLOCK, predictions=(d, c)).mu)


def _chain_sql(steps: int) -> str:
    """The field fitted to the small table by preconditioned steps, with expectations over the enumerated states."""
    step = 0.5 / len(SMALL_QUERIES)
    singles = " UNION ALL ".join(f"SELECT param, ln(greatest(d, 0.5)) - avg(ln(greatest(d, 0.5))) OVER () AS mu FROM dat, sz s WHERE param >= {at} AND param < {at} + {SMALL.cell_sql(n)[1]}" for n, at in zip(SMALL_NAMES, ("0", "s.l_linestatus", "s.l_linestatus + s.l_linenumber")))
    head = f""",
pr AS (SELECT unnest(range(0, (SELECT {' + '.join(SMALL.cell_sql(q)[1] for q in SMALL_QUERIES)} FROM sz s))) AS param),
obs AS (SELECT param, count(*) AS d, sum(label) AS c FROM (SELECT label, CAST(unnest([{', '.join(_params_sql(SMALL, SMALL_QUERIES))}]) AS BIGINT) AS param FROM enc e, sz s) GROUP BY param),
dat AS MATERIALIZED (SELECT pr.param, CAST(COALESCE(d, 0) AS DOUBLE) AS d, CAST(COALESCE(c, 0) AS DOUBLE) AS c FROM pr LEFT JOIN obs USING (param)),
al AS (SELECT count(*) AS n, ln(sum(label) / (count(*) - sum(label))) AS b FROM enc),
p0 AS MATERIALIZED (SELECT dat.param, COALESCE(i.mu, 0.0) AS mu, 0.0 AS theta FROM dat LEFT JOIN ({singles}) i USING (param))"""
    rounds = "".join(f""",
s{k} AS MATERIALIZED (SELECT state, exp(sum(mu)) * (1 + exp(sum(theta) + any_value(b))) AS w, 1 / (1 + exp(-(sum(theta) + any_value(b)))) AS p FROM kp JOIN p{k} USING (param), al GROUP BY state),
e{k} AS (SELECT param, sum(w) / (SELECT sum(w) FROM s{k}) * (SELECT n FROM al) AS ed, sum(w * p) / (SELECT sum(w) FROM s{k}) * (SELECT n FROM al) AS ec FROM kp JOIN s{k} USING (state) GROUP BY param),
p{k + 1} AS MATERIALIZED (SELECT param, mu - {step!r} * greatest(-2.0, least(2.0, (COALESCE(ed, 0) - d + 32.0 * mu) / (32.0 + 0.5 * COALESCE(ed, 0) + 0.5 * d))) AS mu,
  theta - {step!r} * greatest(-2.0, least(2.0, (COALESCE(ec, 0) - c + 32.0 * theta) / (32.0 + 0.5 * COALESCE(ec, 0) + 0.5 * c))) AS theta FROM p{k} JOIN dat USING (param) LEFT JOIN e{k} USING (param))""" for k in range(steps))
    fields = _FIELDS_SQL.split("sc AS (")[0].rstrip().rstrip(",")
    return f"{fields}{head}{rounds} SELECT param, round(mu, 5) + 0.0 AS mu, round(theta, 5) + 0.0 AS theta FROM p{steps}"


@register("mrf_fit_enumerated", _chain_sql(3))
def mrf_fit_enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of the fit with exact expectations instead of samples."""
    table, q, _ = _small(spark, sf_dir)
    model = mrf.fit(mrf.start(spark, table, q, mrf.Params(exact=True, with_unknown=False)), 3)
    return _parameters(spark, mu=model.mu, theta=model.theta).select("param", *[(F.round(v, 5) + F.lit(0.0)).alias(v) for v in ("mu", "theta")])


def _fixed_model(spark: SparkSession, sf_dir: str) -> tuple[mrf.Model, DataFrame]:
    _, q, encoded = _small(spark, sf_dir)
    mu, theta = _fixed_vectors(q)
    zero = np.zeros(q.total)
    return mrf.Model(q, mrf.Params(exact=True), zero, zero, 1.0, 0.5, mu, theta, BIAS, 0.25, zero > -1), encoded


_ROWS_SQL = f"""WITH {SMALL.sql()},
p AS (SELECT e.*, {' + '.join('(' + FIXED_SQL['mu'].format(x) + ')' for x in _params_sql(SMALL, SMALL_QUERIES))} + 0.25 AS mu, {' + '.join('(' + FIXED_SQL['theta'].format(x) + ')' for x in _params_sql(SMALL, SMALL_QUERIES))} + {BIAS} AS log_odds FROM enc e, sz s)"""


@register("mrf_predict_fixed", f"{_ROWS_SQL} SELECT row_key, round(log_odds, 6) AS \"lambda\", round(mu, 6) AS mu, round(exp(log_odds) * exp(mu), 6) AS explambda, round(1 / (1 + exp(-log_odds)), 6) AS prediction FROM p")
def mrf_predict_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, encoded = _fixed_model(spark, sf_dir)
    return mrf.predict(encoded, model).select("row_key", *[F.round(c, 6).alias(c) for c in ("lambda", "mu", "explambda", "prediction")])


@register("mrf_expected_counts", f"{_ROWS_SQL} SELECT l_linestatus, l_linenumber, round(sum(exp(mu) * (1 + label)), 4) AS e_no_click, round(sum(exp(log_odds) * exp(mu) * (1 + label)), 4) AS e_click, round(sum((exp(mu) + exp(log_odds) * exp(mu)) * (1 + label)), 4) AS e_display FROM p GROUP BY ALL")
def mrf_expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, encoded = _fixed_model(spark, sf_dir)
    scored = mrf.predict(encoded.withColumn("weight", F.col("label") + 1), model, weight="weight")
    return scored.groupBy("l_linestatus", "l_linenumber").agg(*[F.round(F.sum(c), 4).alias(c) for c in ("e_no_click", "e_click", "e_display")])


# ---- simple models and metrics --------------------------------------------------------------------------------------

_RATE = "(sum(label) OVER (PARTITION BY {0}) + 1.0) / (count(*) OVER (PARTITION BY {0}) + 2.0)"
_SCORED_SQL = f"WITH {RETURNS.sql()},\nscored AS (SELECT *, {_RATE.format('l_quantity')} AS p1, {_RATE.format('l_discount')} AS p2 FROM enc)"


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, QuerySet]:
    """Rows with two simple predictions, from the singles' tables: bounded, broadcast lookups."""
    table, q, encoded, _ = table_of(spark, sf_dir, RETURNS, "*")
    table = stage(table, "singles")  # looked up twice
    for name, feature in (("p1", "l_quantity"), ("p2", "l_discount")):
        own = table.filter(F.col("query") == feature).select(F.col("cell").alias("__c"), ((F.col("clicks") + 1.0) / (F.col("displays") + 2.0)).alias(name))
        encoded = encoded.join(F.broadcast(own), F.col(feature) == F.col("__c")).drop("__c")
    return encoded, q


_NB_TERMS = " + ".join(f"ln(((sum(label) OVER (PARTITION BY {n}) + r) / (count(*) OVER (PARTITION BY {n}) + 1.0)) / r)" for n in RETURN_NAMES)
_NB_DOWN = " + ".join(f"ln((1 - (sum(label) OVER (PARTITION BY {n}) + r) / (count(*) OVER (PARTITION BY {n}) + 1.0)) / (1 - r))" for n in RETURN_NAMES)


@register("nb_predict", f"WITH {RETURNS.sql()}, t AS (SELECT sum(label) / count(*) AS r FROM enc), u AS (SELECT row_key, r, {_NB_TERMS} AS up, {_NB_DOWN} AS down FROM enc, t) SELECT row_key, round(1 / (1 + exp(-(ln(r) + up - ln(1 - r) - down))), 6) AS prediction FROM u")
def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, encoded, _ = table_of(spark, sf_dir, RETURNS, "*")
    return models.naive_bayes(encoded, table, q).select("row_key", F.round("prediction", 6).alias("prediction"))


@register("ensemble_mean", f"{_SCORED_SQL} SELECT row_key, round((p1 + p2) / 2, 8) AS prediction FROM scored")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[0].select("row_key", F.round(models.ensemble([F.col("p1"), F.col("p2")]), 8).alias("prediction"))


@register("ensemble_logit", f"{_SCORED_SQL} SELECT row_key, round(1 / (1 + exp(-(ln(p1 / (1 - p1)) + ln(p2 / (1 - p2))) / 2)), 8) AS prediction FROM scored")
def ensemble_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[0].select("row_key", F.round(models.ensemble([F.col("p1"), F.col("p2")], logit=True), 8).alias("prediction"))


_LLH = "avg(label * ln(p1) + (1 - label) * ln(1 - p1))"


@register("llh", f"{_SCORED_SQL} SELECT round({_LLH}, 8) AS llh FROM scored")
def llh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.llh(_scored(spark, sf_dir)[0], "label", "p1").select(F.round("llh", 8).alias("llh"))


@register("nllh", f"{_SCORED_SQL}, s AS (SELECT {_LLH} AS llh, avg(label) AS r FROM scored), h AS (SELECT llh, r * ln(r) + (1 - r) * ln(1 - r) AS h FROM s) SELECT round(llh, 8) AS llh, round(h, 8) AS entropy, round((h - llh) / h, 8) AS nllh FROM h")
def nllh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nllh(_scored(spark, sf_dir)[0], "label", "p1").select(*[F.round(c, 8).alias(c) for c in ("llh", "entropy", "nllh")])


@register("nmse", f"{_SCORED_SQL}, s AS (SELECT avg((label - p1) * (label - p1)) AS mse, var_pop(label) AS v FROM scored) SELECT round(mse, 8) AS mse, round((v - mse) / v, 8) AS nmse FROM s")
def nmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nmse(_scored(spark, sf_dir)[0], "label", "p1").select(*[F.round(c, 8).alias(c) for c in ("mse", "nmse")])


@register("auc", f"{_SCORED_SQL}, b AS (SELECT round(p1, 9) AS p, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY 1), r AS (SELECT pos, neg, COALESCE(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 8) AS auc FROM r")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(_scored(spark, sf_dir)[0], "label", "p1").select(F.round("auc", 8).alias("auc"))


_ERRORS = "\nUNION ALL\n".join(f"SELECT '{n}' AS query, {n} AS cell, sum(label) AS y, sum(p1) AS p FROM scored GROUP BY ALL" for n in RETURN_NAMES)


@register("agg_l1", f"{_SCORED_SQL}, t AS ({_ERRORS}) SELECT query, round(sum(abs(y - p)) / sum(y), 8) AS agg_l1 FROM t GROUP BY query")
def agg_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, q = _scored(spark, sf_dir)
    return metrics.per_feature_errors(scored, q, "label", "p1").select("query", F.round("agg_l1", 8).alias("agg_l1"))


@register("agg_se", f"{_SCORED_SQL}, t AS ({_ERRORS}) SELECT query, round(sum((y - p) * (y - p)) / sum(y), 6) AS agg_se FROM t GROUP BY query")
def agg_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, q = _scored(spark, sf_dir)
    return metrics.per_feature_errors(scored, q, "label", "p1").select("query", F.round("agg_se", 6).alias("agg_se"))


_POISSON = f"{_SCORED_SQL}, t AS ({_ERRORS}), sc AS (SELECT query, sum((y + 0.5 + 4.0) * ln((y + 0.5 + 4.0) / (p + 0.5 + 4.0)) - (y + 4.5) + (p + 4.5)) AS score FROM t GROUP BY query)"


def _divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, q = _scored(spark, sf_dir)
    table = agg.aggregate(scored, q, {"y": F.col("label").cast("double"), "p": F.col("p1")})
    return metrics.poisson_score(table, "y", "p", 4.0)


@register("poisson_score_fixed", f"{_POISSON} SELECT query, round(score, 6) AS score FROM sc")
def poisson_score_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence(spark, sf_dir).select("query", F.round("score", 6).alias("score"))


@register("poisson_score_common", f"{_SCORED_SQL}, t AS ({_ERRORS}), m AS (SELECT query, 10000.0 * y / sum(y) OVER (PARTITION BY query) + 50.5 AS y, 10000.0 * p / sum(p) OVER (PARTITION BY query) + 50.5 AS p FROM t) SELECT query, round(sum(y * ln(y / p) - y + p), 6) AS score FROM m GROUP BY query")
def poisson_score_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides scaled to 10,000 in every query."""
    scored, q = _scored(spark, sf_dir)
    table = agg.aggregate(scored, q, {"y": F.col("label").cast("double"), "p": F.col("p1")})
    return metrics.poisson_score(stage(table, "cells"), "y", "p", 50.0, 10_000.0).select("query", F.round("score", 6).alias("score"))


@register("topk_divergence", f"{_POISSON} SELECT query, round(score, 6) AS score FROM sc ORDER BY score DESC, query LIMIT 3")
def topk_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.worst_queries(_divergence(spark, sf_dir)).select("query", F.round("score", 6).alias("score"))


@register("worst_feature", f"{_POISSON} SELECT query, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, query DESC LIMIT 1")
def worst_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.worst_query(_divergence(spark, sf_dir)).select("query", F.round("score", 6).alias("score"))


@register("cum_mass_curve", f"{_SCORED_SQL}, t AS (SELECT l_quantity AS cell, sum(label) AS y, sum(p2) AS p FROM scored GROUP BY ALL) SELECT CAST(row_number() OVER w AS INTEGER) AS rank, cell, round(sum(y) OVER w / sum(y) OVER (), 8) AS observed_share, round(sum(p) OVER w / sum(p) OVER (), 8) AS expected_share FROM t WINDOW w AS (ORDER BY y DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def cum_mass_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, q = _scored(spark, sf_dir)
    table = agg.aggregate(scored, q, {"y": F.col("label").cast("double"), "p": F.col("p2")})
    curve = metrics.mass_curve(table, "l_quantity", "y", "p")
    return curve.select(F.col("rank").cast("int").alias("rank"), "cell", F.round("observed_share", 8).alias("observed_share"), F.round("expected_share", 8).alias("expected_share"))


_AREA_SQL = f"""{_SCORED_SQL}, t AS (SELECT l_quantity AS cell, CAST(sum(label) AS DOUBLE) AS y, sum(p2) AS p FROM scored GROUP BY ALL),
cdf AS (SELECT cell, sum(y) OVER (ORDER BY cell) / sum(y) OVER () AS hi FROM t),
dr AS (SELECT (CAST(CAST('0x' || substr(md5('a|' || i), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0 AS u FROM range(20000) r(i)),
z AS (SELECT cell, count(*) AS z FROM dr ASOF JOIN cdf ON dr.u < cdf.hi GROUP BY cell),
tz AS (SELECT t.cell, y, p, COALESCE(z, 0) AS z FROM t LEFT JOIN z USING (cell) WHERE y > 0 OR p > 0),
cu AS (SELECT sum(y) OVER w / sum(y) OVER () AS d, sum(p) OVER w / sum(p) OVER () AS p, sum(z) OVER w / sum(z) OVER () AS z FROM tz WINDOW w AS (ORDER BY y DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round(abs(avg(p) - avg(z)), 8) AS area, round(abs(avg(d) - avg(z)), 8) AS area_of_sampling FROM cu"""


@register("curve_area", _AREA_SQL)
def curve_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature's cumulative shares as predicted, against a multinomial resample of the observed ones."""
    scored, q = _scored(spark, sf_dir)
    table = agg.aggregate(scored, q, {"y": F.col("label").cast("double"), "p": F.col("p2")})
    return metrics.curve_area(stage(table, "cells"), "l_quantity", "y", "p", 20_000, "a").select(*[F.round(c, 8).alias(c) for c in ("area", "area_of_sampling")])


# ---- fits and samplers: no SQL says the same; tests hold them against enumeration ----------------------------------


@register("gibbs_samples")
def gibbs_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples after three sweeps of the fixed field."""
    model, _ = _fixed_model(spark, sf_dir)
    table, q, _ = _small(spark, sf_dir)
    own = model.as_field()
    started = sampling.independent(spark, q, {f: np.ones(q.sizes[f]) for f in q.features}, 5_000, 1, 8)
    for k in range(3):
        started = sampling.sweep(started, own, 1, k, negatives=k < 2, blocked=k == 1)
    return started


def _fitted(spark: SparkSession, sf_dir: str, iterations: int = 5, **settings: object) -> tuple[mrf.Model, DataFrame]:
    table, q, encoded = _small(spark, sf_dir)
    return mrf.fit(mrf.start(spark, table, q, mrf.Params(n_samples=5_000, **settings)), iterations), encoded


def _parameters(spark: SparkSession, **vectors: np.ndarray) -> DataFrame:
    rows = zip(range(len(next(iter(vectors.values())))), *[v.tolist() for v in vectors.values()], strict=True)
    return spark.createDataFrame(list(rows), "param long, " + ", ".join(f"{k} double" for k in vectors))


@register("mrf_fit")
def mrf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _fitted(spark, sf_dir)
    return _parameters(spark, mu=model.mu, theta=model.theta)


@register("mrf_fit_private")
def mrf_fit_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From Gaussian-noised tables, with the noise in the likelihood and samples of its own for it."""
    table, q, _ = _small(spark, sf_dir)
    noisy = privacy.make_private(table, q, 6.0, 1e-5, seed="t")
    sigma = noise.gauss_sigma(6.0, 1e-5, 2 * len(q.queries))
    settings = mrf.Params(n_samples=5_000, noise="gauss", noise_scale=sigma, separate_noise_samples=True, project_noise=True, with_unknown=False)
    model = mrf.fit(mrf.start(spark, noisy, q, settings), 3)
    return _parameters(spark, mu=model.mu, theta=model.theta)


@register("mrf_fit_exact")
def mrf_fit_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, _ = _small(spark, sf_dir)
    model = mrf.fit_exact(mrf.start(spark, table, q, mrf.Params(exact=True, with_unknown=False)), 15)
    return _parameters(spark, mu=model.mu, theta=model.theta)


@register("mrf_metrics")
def mrf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, encoded = _fitted(spark, sf_dir, 3)
    scored = mrf.predict(encoded, model)
    return metrics.nllh(scored, "label", "prediction").crossJoin(metrics.auc(scored, "label", "prediction"))


@register("mrf_baseline_fit")
def mrf_baseline_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the aggregates of a baseline prediction."""
    fixed, encoded = _fixed_model(spark, sf_dir)
    q = fixed.queries
    scored = mrf.predict(encoded, fixed)
    table = agg.aggregate(scored, q, counts() | {"p0": F.col("prediction")})
    model = mrf.start(spark, table, q, mrf.Params(n_samples=2_000))
    model, field = baseline_mrf.fit_with_baseline(model, table, fixed.theta, fixed.bias, 2)
    return _parameters(spark, mu=model.mu, theta=model.theta, nu=field.nu)


@register("mrf_row_samples_fit")
def mrf_row_samples_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, encoded = _small(spark, sf_dir)
    model = mrf.start(spark, table, q, mrf.Params(n_samples=100))
    rows = encoded.withColumn("id", F.xxhash64("row_key"))
    model = baseline_mrf.fit_on_rows(baseline_mrf.with_row_samples(model, rows, "id"), 2)
    return _parameters(spark, mu=model.mu, theta=model.theta)


def _logistic_ctes(names: list[str], steps: int, x: str = "") -> str:
    """The aggregate logistic over some of the small queries by preconditioned steps, as CTEs ending in p<x>_<steps>.
    Rows with the same ids count as one state, with its parameters in k<x>."""
    step = 1.0 / len(names)
    params, size = ", ".join(_params_sql(SMALL, names)), " + ".join(SMALL.cell_sql(q)[1] for q in names)
    head = f"""
k{x} AS MATERIALIZED (SELECT state, n, y, CAST(unnest([{params}]) AS BIGINT) AS param FROM st e, sz s),
r{x} AS (SELECT unnest(range(0, (SELECT {size} FROM sz s))) AS param),
d{x} AS MATERIALIZED (SELECT r.param, CAST(COALESCE(sum(y), 0) AS DOUBLE) AS c FROM r{x} r LEFT JOIN k{x} USING (param) GROUP BY r.param),
p{x}_0 AS MATERIALIZED (SELECT param, 0.0 AS theta FROM d{x})"""
    rounds = "".join(f""",
s{x}_{k} AS MATERIALIZED (SELECT state, 1 / (1 + exp(-(sum(theta) + any_value(b)))) AS p FROM k{x} JOIN p{x}_{k} USING (param), al GROUP BY state),
e{x}_{k} AS (SELECT param, sum(n * p) AS ec FROM k{x} JOIN s{x}_{k} USING (state) GROUP BY param),
p{x}_{k + 1} AS MATERIALIZED (SELECT param, theta - {step!r} * greatest(-2.0, least(2.0, (COALESCE(ec, 0) - c + 32.0 * theta) / (32.0 + 0.5 * COALESCE(ec, 0) + 0.5 * c + 1e-9))) AS theta FROM p{x}_{k} JOIN d{x} USING (param) LEFT JOIN e{x}_{k} USING (param))""" for k in range(steps))
    return head + rounds


_STATES_SQL = f"""WITH {SMALL.sql()},
st AS MATERIALIZED (SELECT row_number() OVER () AS state, count(*) AS n, sum(label) AS y, {', '.join(SMALL_NAMES)} FROM enc GROUP BY {', '.join(SMALL_NAMES)}),
al AS (SELECT ln(sum(label) / (count(*) - sum(label))) AS b FROM enc),"""


def _ensemble_sql(steps: int) -> str:
    """One logistic per pair of features, each with all singles; the mean of their log odds."""
    pairs = SMALL_QUERIES[len(SMALL_NAMES) :]
    models_ = ",".join(_logistic_ctes([*SMALL_NAMES, p], steps, str(i)) for i, p in enumerate(pairs))
    odds = ",\n".join(f"z{i} AS (SELECT state, sum(theta) + any_value(b) AS z FROM k{i} JOIN p{i}_{steps} USING (param), al GROUP BY state)" for i in range(len(pairs)))
    mean = " + ".join(f"z{i}.z" for i in range(len(pairs)))
    joins = " ".join(f"JOIN z{i} ON z{i}.state = st.state" for i in range(len(pairs)))
    return f"{_STATES_SQL}{models_},\n{odds}\nSELECT row_key, round(1 / (1 + exp(-({mean}) / {len(pairs)})), 6) AS prediction FROM enc JOIN st USING ({', '.join(SMALL_NAMES)}) {joins}"


@register("agglogistic_fit", f"{_STATES_SQL}{_logistic_ctes(SMALL_QUERIES, 10)} SELECT param, round(theta, 6) + 0.0 AS theta FROM p_10")
def agglogistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, encoded = _small(spark, sf_dir)
    return _parameters(spark, theta=models.fit_aggregate_logistic(table, encoded, q, 10).theta).select("param", (F.round("theta", 6) + F.lit(0.0)).alias("theta"))


_NB_FIELD = " * ".join(f"((sum(label) OVER (PARTITION BY {n}) / c) / ((count(*) OVER (PARTITION BY {n}) - sum(label) OVER (PARTITION BY {n})) / (n - c)))" for n in SMALL_NAMES)


@register("naive_bayes_field", f"WITH {SMALL.sql()}, al AS (SELECT count(*) AS n, sum(label) AS c FROM enc), o AS (SELECT row_key, c / (n - c) * {_NB_FIELD} AS odds FROM enc, al) SELECT row_key, round(odds / (1 + odds), 3) AS prediction FROM o")
def naive_bayes_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes as a field without pairs: at the optimum the features are independent given the label."""
    table, q, encoded, _ = table_of(spark, sf_dir, SMALL, "*")
    settings = mrf.Params(display_spec="*", click_spec="*", exact=True, with_unknown=False, l2_mu=1e-6, l2_theta=1e-6)
    model = mrf.fit_exact(mrf.start(spark, table, q, settings), 400)
    return mrf.predict(encoded, model).select("row_key", F.round("prediction", 3).alias("prediction"))


@register("gibbs_mixing")
def gibbs_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far samples have moved after three sweeps, against new values dealt at random."""
    model, _ = _fixed_model(spark, sf_dir)
    q = model.queries
    return sampling.mixing(sampling.independent(spark, q, {f: np.ones(q.sizes[f]) for f in q.features}, 5_000, 1, 8), model.as_field(), 3)


@register("rao_blackwell")
def rao_blackwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations over samples with one feature of each query averaged over its law."""
    model, _ = _fixed_model(spark, sf_dir)
    q = model.queries
    return sampling.rao_blackwell(sampling.independent(spark, q, {f: np.ones(q.sizes[f]) for f in q.features}, 5_000, 1, 8), model.as_field())


@register("multinomial_logistic")
def multinomial_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic model from the tables alone, on samples chained a feature at a time."""
    table, q, encoded = _small(spark, sf_dir)
    model = models.fit_chained_logistic(spark, stage(table, "cells"), q, 2_000, 5)
    return model.predict(encoded).select("row_key", "prediction")


@register("mrf_fit_beta")
def mrf_fit_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From Gaussian-noised tables, the noise's expectation given a beta-binomial law of the counts."""
    table, q, _ = _small(spark, sf_dir)
    noisy = privacy.make_private(table, q, 6.0, 1e-5, seed="t")
    sigma = noise.gauss_sigma(6.0, 1e-5, 2 * len(q.queries))
    model = mrf.fit(mrf.start(spark, noisy, q, mrf.Params(n_samples=5_000, noise="gauss_beta", noise_scale=sigma, with_unknown=False)), 3)
    return _parameters(spark, mu=model.mu, theta=model.theta)


@register("multinomial_chain")
def multinomial_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, _ = _small(spark, sf_dir)
    return models.chained_samples(spark, table, q, 2_000, 3)


@register("logistic_ensemble", _ensemble_sql(3))
def logistic_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, q, encoded = _small(spark, sf_dir)
    fitted = models.logistic_ensemble(table, encoded, q, 3)
    for k, m in enumerate(fitted):
        encoded = m.predict(encoded, name=f"p{k}")
    return encoded.select("row_key", F.round(models.ensemble([F.col(f"p{k}") for k in range(len(fitted))], logit=True), 6).alias("prediction"))


@register("hashed_logistic")
def hashed_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = SMALL.rows(spark, sf_dir)
    predict = models.hashed_logistic(rows, SMALL_NAMES, "label", [("l_linestatus", "l_linenumber")], 1 << 12, iterations=10)
    return predict(rows).select("row_key", "prediction")


@register("random_projection")
def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = SMALL.rows(spark, sf_dir)
    _, predict = models.private_projected_logistic(rows, SMALL_NAMES, "label", 5.0, 16, iterations=4)
    return predict(rows).select("row_key", "prediction")


@register("stream_aggregate", cells(SMALL, SMALL_QUERIES))
def stream_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship aggregate by Structured Streaming: the table's files arrive as a stream, the state is a row per cell."""
    import uuid

    from crosstally.sources.staging import shared_dir
    from crosstally.streaming.incremental import run_to_table, stream_aggregate as streamed

    static = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    known = dictionary.fit(SMALL.rows(spark, sf_dir), SMALL_NAMES)
    stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/lineitem.parq[u]et")
    rows = stream.select(*[F.expr(e).alias(n) for n, e in SMALL.features], F.expr(SMALL.label).cast("int").alias("label"))
    return run_to_table(streamed(rows, known, SMALL.queries(known), counts()), f"{shared_dir(spark)}/staged/cells-{uuid.uuid4().hex}")
