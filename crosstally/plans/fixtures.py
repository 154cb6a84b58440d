"""The encoded tables that the registered queries work on, each as a Spark frame and as DuckDB SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.operators.dictionary import Dictionaries, fit
from crosstally.plans.grammar import QuerySet


@dataclass(frozen=True)
class Fixture:
    """Features as (name, SQL expression), a label expression, and the rows they come from. The expressions are SQL that
    both engines read alike."""

    table: str
    features: tuple[tuple[str, str], ...]
    label: str
    key: str

    def names(self) -> list[str]:
        return [n for n, _ in self.features]

    def rows(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = self.table.split(" JOIN ")
        df = spark.read.parquet(f"{sf_dir}/{tables[0]}.parquet")
        for other in tables[1:]:
            name, on = other.split(" ON ")
            left, right = on.split(" = ")
            df = df.join(spark.read.parquet(f"{sf_dir}/{name}.parquet"), F.col(left) == F.col(right))
        return df.select(*[F.expr(e).alias(n) for n, e in self.features], F.expr(self.label).cast("int").alias("label"), F.expr(self.key).alias("row_key"))

    def encoded(self, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Dictionaries]:
        """(ids, label, row_key); the dictionaries are fitted on the same rows."""
        rows = self.rows(spark, sf_dir)
        known = fit(rows, self.names())
        return known.encode(rows, self.names()), known

    def queries(self, known: Dictionaries, spec: str = "*&*", caps: int | dict[str, int] | None = None) -> QuerySet:
        return QuerySet.build(known.sizes, spec, caps)

    def sql(self) -> str:
        """CTEs ``base`` (values), ``enc`` (ids) and ``n_<feature>`` (sizes with the unknown one)."""
        tables = self.table.split(" JOIN ")
        source = tables[0] + "".join(f" JOIN {t}" for t in tables[1:])
        values = ", ".join(f"{e} AS {n}" for n, e in self.features)
        ids = ", ".join(f"CAST(dense_rank() OVER (ORDER BY {n}) - 1 AS INTEGER) AS {n}" for n in self.names())
        sizes = ", ".join(f"CAST(count(DISTINCT {n}) + 1 AS INTEGER) AS {n}" for n in self.names())
        return f"base AS (SELECT {values}, CAST({self.label} AS INTEGER) AS label, {self.key} AS row_key FROM {source}),\nenc AS (SELECT {ids}, label, row_key FROM base),\nsz AS (SELECT {sizes} FROM base)"

    def cell_sql(self, name: str, caps: dict[str, int] | int | None = None) -> tuple[str, str]:
        """(cell, size) of a query, as expressions over a row of ``enc e`` joined with ``sz s``."""
        cap = lambda q: caps if isinstance(caps, int) or caps is None else caps.get(q, caps.get("default"))
        size = lambda f: f"s.{f}" if cap(f) is None else f"least(s.{f}, {cap(f)})"
        if "&" not in name:
            return f"CAST(e.{name} % {size(name)} AS INTEGER)", size(name)
        a, b = sorted(name.split("&"))
        exact, most = f"({size(a)} * {size(b)})", cap(f"{a}&{b}")
        if most is None:
            return f"CAST((e.{a} + {size(a)} * CAST(e.{b} AS BIGINT)) % {exact} AS INTEGER)", exact
        step, total = f"CASE WHEN {exact} > {most} THEN 7907 ELSE {size(a)} END", f"least({exact}, {most})"
        return f"CAST((e.{a} + ({step}) * CAST(e.{b} AS BIGINT)) % {total} AS INTEGER)", total

    def agg_sql(self, names: list[str], measures: dict[str, str] | None = None, caps: dict[str, int] | int | None = None, where: str = "TRUE") -> str:
        """SELECT of the long table for the named queries, after the CTEs of ``sql()``."""
        measures = measures or {"displays": "count(*)", "clicks": "CAST(sum(label) AS BIGINT)"}
        picks = ", ".join(f"{e} AS {n}" for n, e in measures.items())
        return "\nUNION ALL\n".join(f"SELECT '{q}' AS query, {self.cell_sql(q, caps)[0]} AS cell, {picks} FROM enc e, sz s WHERE {where} GROUP BY ALL" for q in names)


RETURNS = Fixture(
    "lineitem",
    (("l_linestatus", "l_linestatus"), ("l_linenumber", "l_linenumber"), ("l_discount", "l_discount"), ("l_tax", "l_tax"), ("l_quantity", "l_quantity")),
    "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "concat(l_orderkey, '-', l_linenumber)",
)
SMALL = Fixture("lineitem", RETURNS.features[:3], RETURNS.label, RETURNS.key)
CLICKS = Fixture("events", (("user_id", "user_id"), ("k", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"), ("hour", "CAST(hour(ts) AS BIGINT)")), "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END", "CAST(event_id AS STRING)")
ORDERS = Fixture(
    "orders JOIN customer ON o_custkey = c_custkey",
    (("c_mktsegment", "c_mktsegment"), ("c_nationkey", "c_nationkey"), ("o_orderpriority", "o_orderpriority")),
    "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "CAST(o_orderkey AS STRING)",
)
#: Eleven features, 66 queries.
WIDE = Fixture(
    "lineitem",
    (
        *RETURNS.features[:4],
        *((f"{n}_mod", f"CAST({c} % {m} AS BIGINT)") for n, c, m in (("order", "l_orderkey", 5), ("part", "l_partkey", 13), ("qty", "l_quantity", 10), ("supp", "l_suppkey", 7))),
        *((f"ship_{n}", f"CAST({n}(l_shipdate) AS BIGINT)") for n in ("day", "month", "year")),
    ),
    RETURNS.label,
    RETURNS.key,
)
PARTS = Fixture("lineitem", (("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")), RETURNS.label, RETURNS.key)


def pair_names(features: list[str]) -> list[str]:
    return [f"{a}&{b}" for a, b in dict.fromkeys(tuple(sorted((a, b))) for a in features for b in features if a != b)]
