"""Registered queries over the base tables, each next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import random
from quarry.operators import anchors, conditional, counting, dependency, fitting, formats, patterns, profiling, validation
from quarry.operators import reconstruct as rebuilding
from quarry.sources import tables
from quarry.sources.tables import ROW_ID

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def all_of(template: str, items: list) -> str:
    return "\nUNION ALL\n".join(template.format(*(x if isinstance(x, tuple) else (x,))) for x in items)


# The columns of the base tables that the queries describe.
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# --- profiling -----------------------------------------------------------------------------------------------------


@query(
    all_of(
        "SELECT '{0}' AS tab, '{1}' AS col, count(*) AS n_total, count(*) - count({1}) AS n_null, count(DISTINCT {1}) AS n_unique,"
        " count(*) > 0 AND count(DISTINCT {1}) = count(*) AS is_unique FROM {0}",
        [(t, c) for t, cs in COLUMNS.items() for c in cs],
    )
)
def profile_counts(spark, sf_dir):
    parts = [profiling.column_counts(table(spark, sf_dir, t).select(*cs)).select(F.lit(t).alias("tab"), F.col("column").alias("col"), "n_total", "n_null", "n_unique", "is_unique") for t, cs in COLUMNS.items()]
    return union(parts)


@query(
    all_of(
        "SELECT '{0}' AS col, count({0}) AS n, round(avg({0}), 5) AS mean, round(stddev_samp({0}), 5) AS std, min({0}) AS lo, max({0}) AS hi,"
        " round(quantile_cont({0}, 0.25), 6) AS q25, round(quantile_cont({0}, 0.5), 6) AS q50, round(quantile_cont({0}, 0.75), 6) AS q75,"
        " round(skewness({0}), 6) AS skewness, round(kurtosis({0}), 6) AS kurtosis FROM lineitem",
        MEASURES,
    )
)
def profile_numeric_stats(spark, sf_dir):
    stats = profiling.numeric_stats(table(spark, sf_dir, "lineitem").select(*MEASURES), MEASURES)
    out = stats.select(F.col("column").alias("col"), "n", "mean", "std", F.col("min").alias("lo"), F.col("max").alias("hi"), "q25", "q50", "q75", "skewness", "kurtosis")
    return rounded(rounded(out, 5, "mean", "std"), 6, "q25", "q50", "q75", "skewness", "kurtosis")


TOP_OF = [("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("events", "event_type"), ("part", "p_type"), ("customer", "c_mktsegment")]


@query(
    all_of(
        "SELECT * FROM (SELECT '{1}' AS col, CAST({1} AS VARCHAR) AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({1} AS VARCHAR)) AS rank"
        " FROM {0} WHERE {1} IS NOT NULL GROUP BY {1}) WHERE rank <= 20",
        TOP_OF,
    )
)
def profile_top_values(spark, sf_dir):
    parts = [profiling.top_values(profiling.labelled_counts(table(spark, sf_dir, t).select(c))) for t, c in TOP_OF]
    return union(parts).select(F.col("column").alias("col"), "v", "n", F.col("rank").cast("long").alias("rank"))


DATES = [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]


@query(
    all_of(
        "SELECT '{1}' AS col, round(epoch_us(min({1})) / 1e6, 3) AS min_s, round(epoch_us(max({1})) / 1e6, 3) AS max_s,"
        " round((epoch_us(max({1})) - epoch_us(min({1}))) / 1e6 / 86400.0, 6) AS range_days FROM {0}",
        DATES,
    )
)
def profile_datetime(spark, sf_dir):
    out = union([profiling.datetime_stats(table(spark, sf_dir, t).select(c), [c]) for t, c in DATES])
    return rounded(rounded(out.select(F.col("column").alias("col"), "min_s", "max_s", "range_days"), 3, "min_s", "max_s"), 6, "range_days")


@query("SELECT 'iso' AS col, round(min(epoch_us(o_orderdate)) / 1e6, 3) AS min_s, round(max(epoch_us(o_orderdate)) / 1e6, 3) AS max_s FROM orders")
def profile_datetime_text(spark, sf_dir):
    texts = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssZ").alias("iso"))
    out = profiling.datetime_stats(texts, ["iso"]).select(F.col("column").alias("col"), "min_s", "max_s")
    return rounded(out, 3, "min_s", "max_s")


TYPED = [("orders", c) for c in COLUMNS["orders"]] + [("lineitem", c) for c in COLUMNS["lineitem"]] + [("part", c) for c in COLUMNS["part"]]


@query(
    all_of(
        "SELECT '{1}' AS col, CASE WHEN typeof(any_value({1})) IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN typeof(any_value({1})) LIKE 'TIMESTAMP%' THEN 'datetime'"
        " WHEN count(DISTINCT {1}) / count(*) < 0.05 THEN 'categorical' ELSE 'string' END AS column_type FROM {0}",
        TYPED,
    )
)
def detect_types(spark, sf_dir):
    out = union([profiling.column_types(table(spark, sf_dir, t)) for t in ("orders", "lineitem", "part")])
    return out.select(F.col("column").alias("col"), "column_type")


@query(
    """SELECT col, CASE WHEN email >= 0.95 THEN 'email' WHEN url >= 0.95 THEN 'url' WHEN uuid >= 0.95 THEN 'uuid' WHEN phone >= 0.95 THEN 'phone' ELSE 'none' END AS regex_pattern
FROM (SELECT col, avg(CAST(regexp_matches(v, '^[\\w.\\-+]+@[\\w.\\-]+\\.\\w{2,}$') AS INT)) AS email, avg(CAST(regexp_matches(v, '^https?://[^\\s]+$') AS INT)) AS url,
  avg(CAST(regexp_matches(v, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AS INT)) AS uuid,
  avg(CAST(regexp_matches(v, '^[+\\d][\\d\\s\\-().]{6,}$') AS INT)) AS phone
  FROM (SELECT 'url' AS col, url AS v FROM pages
    UNION ALL SELECT 'mail', 'user' || page_id || '@example.com' FROM pages
    UNION ALL SELECT 'phone', '+1 555 ' || CAST(100000 + page_id AS VARCHAR) FROM pages
    UNION ALL SELECT 'html', html FROM pages) GROUP BY col)"""
)
def regex_class(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    made = pages.select(
        "url",
        F.concat(F.lit("user"), "page_id", F.lit("@example.com")).alias("mail"),
        F.concat(F.lit("+1 555 "), (F.lit(100000) + F.col("page_id")).cast("string")).alias("phone"),
        "html",
    )
    return profiling.text_class(profiling.text_ratios(made, made.columns)).select(F.col("column").alias("col"), "regex_pattern")


@query("SELECT 'l_extendedprice' AS col, " + ", ".join(f"round(quantile_cont(l_extendedprice, {i / 10}), 6) AS d{i}" for i in range(11)) + " FROM lineitem")
def quantile_deciles(spark, sf_dir):
    values = counting.long_values(table(spark, sf_dir, "lineitem"), ["l_extendedprice"])
    out = counting.quantiles(counting.value_counts(values, ["column"]), ["column"], {f"d{i}": i / 10 for i in range(11)})
    return rounded(out.withColumnRenamed("column", "col"), 6, *(f"d{i}" for i in range(11)))


# --- dependencies and associations ---------------------------------------------------------------------------------

GEOGRAPHY = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
GEO_COLUMNS = ["c_nationkey", "n_name", "n_regionkey", "r_name", "c_mktsegment"]


def geography(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


@query(
    "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS determinant, '{b}' AS dependent, max(k) = 1 AS holds, max(k) = 1 AND (SELECT max(k2) FROM (SELECT count(DISTINCT {a}) AS k2 FROM {GEOGRAPHY} GROUP BY {b})) = 1 AS is_bijection,
 count(*) AS mapping_size FROM (SELECT count(DISTINCT {b}) AS k FROM {GEOGRAPHY} GROUP BY {a})"""
        for a in GEO_COLUMNS
        for b in GEO_COLUMNS
        if a != b
    )
)
def fd_pairs(spark, sf_dir):
    df = geography(spark, sf_dir).select(*GEO_COLUMNS)
    return dependency.dependencies(df, GEO_COLUMNS).drop("support")


@query(
    all_of(
        "SELECT '{0}' AS determinant, 's_name' AS dependent, max(k) = 1 AS holds FROM (SELECT count(DISTINCT s_name) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY {0})",
        ["n_name", "s_nationkey", "n_regionkey"],
    )
)
def fd_rejected(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return dependency.dependencies(df, ["n_name", "s_nationkey", "n_regionkey"], ["s_name"]).select("determinant", "dependent", "holds")


@query("SELECT n_name AS key, min(r_name) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def fd_lookup(spark, sf_dir):
    df = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return dependency.lookup_table(df, "n_name", "r_name")


PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]


@query(all_of("SELECT '{0}' AS col_a, '{1}' AS col_b, count(*) AS n, round(corr({0}, {1}), 8) AS r FROM lineitem", PAIRS))
def pearson_pairs(spark, sf_dir):
    return rounded(dependency.pearson(table(spark, sf_dir, "lineitem"), PAIRS), 8, "r")


def cramers_sql(source: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(max(n) AS BIGINT) AS n, round(CASE WHEN max(k) = 2 AND max(l) = 2 THEN sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) ELSE sum(pow(o - e, 2) / e) END, 6) AS chi2,
 round(sqrt(CASE WHEN max(k) = 2 AND max(l) = 2 THEN sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) ELSE sum(pow(o - e, 2) / e) END / (max(n) * (least(max(k), max(l)) - 1))), 8) AS v
FROM (SELECT coalesce(c.o, 0) AS o, r.r * cc.c / t.n AS e, t.n, t.k, t.l
  FROM (SELECT {a} AS x, CAST(count(*) AS DOUBLE) AS r FROM {source} GROUP BY 1) r
  CROSS JOIN (SELECT {b} AS y, CAST(count(*) AS DOUBLE) AS c FROM {source} GROUP BY 1) cc
  CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT {a}) AS k, count(DISTINCT {b}) AS l FROM {source}) t
  LEFT JOIN (SELECT {a} AS x, {b} AS y, count(*) AS o FROM {source} GROUP BY 1, 2) c ON c.x = r.x AND c.y = cc.y)"""


CROSSED = [("lineitem", "l_returnflag", "l_linestatus"), ("orders", "o_orderstatus", "o_orderpriority"), (GEOGRAPHY, "c_mktsegment", "r_name")]


@query("\nUNION ALL\n".join(cramers_sql(*x) for x in CROSSED))
def cramers_v(spark, sf_dir):
    sources = {GEOGRAPHY: geography(spark, sf_dir)}
    out = union([dependency.cramers_v(sources.get(s) or table(spark, sf_dir, s), a, b) for s, a, b in CROSSED])
    return rounded(rounded(out, 6, "chi2"), 8, "v")


@query(cramers_sql("(SELECT l_quantity > 25 AS big, l_linestatus FROM lineitem)", "big", "l_linestatus"))
def cramers_v_corrected(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).alias("big"), "l_linestatus")
    return rounded(rounded(dependency.cramers_v(df, "big", "l_linestatus"), 6, "chi2"), 8, "v")


VARIANCE = [("lineitem", "l_returnflag", c) for c in MEASURES] + [("lineitem", "l_linestatus", c) for c in MEASURES] + [("part", "p_type", "p_retailprice"), ("part", "p_brand", "p_retailprice")]


@query(
    all_of(
        "SELECT '{1}' AS category, '{2}' AS number, count(*) AS groups, round(sum(n * pow(m - g, 2)) / max(t), 9) AS eta2 FROM (SELECT {1}, count({2}) AS n, avg({2}) AS m FROM {0} GROUP BY {1})"
        " CROSS JOIN (SELECT avg({2}) AS g, var_pop({2}) * count({2}) AS t FROM {0})",
        VARIANCE,
    )
)
def eta_squared(spark, sf_dir):
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    out = union([dependency.eta_squared(lineitem, c, MEASURES) for c in ("l_returnflag", "l_linestatus")] + [dependency.eta_squared(part, c, ["p_retailprice"]) for c in ("p_type", "p_brand")])
    return rounded(out.drop("large_groups"), 9, "eta2")


DIRECTED = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_linenumber"]


@query(
    "WITH c AS ("
    + all_of("SELECT '{0}' AS col, count(DISTINCT {0}) AS n FROM lineitem", DIRECTED)
    + ") SELECT a.col AS target, b.col AS partner, a.n AS n_target, b.n AS n_partner FROM c a JOIN c b ON a.n < b.n OR (a.n = b.n AND a.col < b.col)"
)
def choose_direction(spark, sf_dir):
    return dependency.directions(table(spark, sf_dir, "lineitem"), DIRECTED)


# --- fitting -------------------------------------------------------------------------------------------------------

FITTED = [("orders", "o_totalprice"), ("events", "value"), ("part", "p_retailprice"), ("lineitem", "l_quantity"), ("customer", "c_acctbal")]


def fitted_counts(spark, sf_dir):
    return fitting.finite_counts(union([counting.long_values(table(spark, sf_dir, t), [c]) for t, c in FITTED]), ["column"])


PARAMETERS_SQL = all_of(
    "SELECT '{1}' AS col, count({1}) AS n, avg({1}) AS mean, stddev_pop({1}) AS std, min({1}) AS lo, max({1}) AS hi,"
    " (SELECT -count(*) / sum(ln((v - lo) / (hi - lo))) FROM (SELECT {1} AS v, min({1}) OVER () AS lo, max({1}) OVER () AS hi FROM {0}) WHERE v > lo) AS a FROM {0}",
    FITTED,
)


@query(f"SELECT col, n, round(mean, 5) AS mean, round(std, 5) AS std, lo, hi, round(a, 6) AS a FROM ({PARAMETERS_SQL})")
def fit_parameters(spark, sf_dir):
    out = fitting.parameters(fitted_counts(spark, sf_dir), ["column"]).withColumnRenamed("column", "col").withColumnRenamed("count", "n")
    return rounded(rounded(out, 5, "mean", "std"), 6, "a")


ERF = "(sign({x}) * (1 - (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-({x}) * ({x}))))"
DISTANCES_SQL = f"""
WITH p AS ({PARAMETERS_SQL}),
x AS ({all_of("SELECT '{1}' AS col, {1} AS v FROM {0} WHERE {1} IS NOT NULL", FITTED)}),
c AS (SELECT col, v, count(*) AS k, sum(count(*)) OVER (PARTITION BY col ORDER BY v) AS upto FROM x GROUP BY col, v),
j AS (SELECT c.col, v, upto / n AS above, (upto - k) / n AS below, mean, std, lo, hi, a, 1 / (1 + 0.3275911 * abs((v - mean) / (std * 1.4142135623730951))) AS t FROM c JOIN p ON c.col = p.col),
f AS (SELECT *, 0.5 * (1 + {ERF.format(x="(v - mean) / (std * 1.4142135623730951)")}) AS fn, 1 - exp(-(v - lo) / (mean - lo)) AS fe, 1 - exp(-(hi - v) / (hi - mean)) AS fr, (v - lo) / (hi - lo) AS fu, pow((v - lo) / (hi - lo), a) AS fp FROM j)
SELECT col, max(greatest(above - fn, fn - below)) AS d_normal, max(greatest(above - fe, fe - below)) AS d_exponential, max(greatest(1 - below - fr, fr - (1 - above))) AS d_exponential_reversed,
 max(greatest(above - fu, fu - below)) AS d_uniform, max(greatest(above - fp, fp - below)) AS d_power_law FROM f GROUP BY col"""
FAMILY_COLUMNS = [f"d_{f}" for f in fitting.FAMILIES]


@query(f"SELECT col, {', '.join(f'round({c}, 7) AS {c}' for c in FAMILY_COLUMNS)} FROM ({DISTANCES_SQL})")
def ks_one_sample(spark, sf_dir):
    out = fitting.distances(fitted_counts(spark, sf_dir), ["column"]).select(F.col("column").alias("col"), *FAMILY_COLUMNS)
    return rounded(out, 7, *FAMILY_COLUMNS)


@query(
    f"""SELECT d.col, CASE greatest(1 - d_normal, 1 - d_exponential, 1 - d_exponential_reversed, 1 - d_uniform, q_power) WHEN 1 - d_normal THEN 'normal' WHEN 1 - d_exponential THEN 'exponential'
 WHEN 1 - d_exponential_reversed THEN 'exponential_reversed' WHEN 1 - d_uniform THEN 'uniform' ELSE 'power_law' END AS family,
 round(greatest(1 - d_normal, 1 - d_exponential, 1 - d_exponential_reversed, 1 - d_uniform, q_power), 7) AS quality
FROM (SELECT d.*, (1 - d_power_law) * CASE WHEN a > 50 OR a < 0.02 THEN 0.5 ELSE 1 END AS q_power FROM ({DISTANCES_SQL}) d JOIN ({PARAMETERS_SQL}) p ON d.col = p.col) d"""
)
def best_distribution(spark, sf_dir):
    out = fitting.best(fitting.distances(fitted_counts(spark, sf_dir), ["column"]))
    return rounded(out.select(F.col("column").alias("col"), "family", "quality"), 7, "quality")


# --- conditional distributions and frequencies ---------------------------------------------------------------------


@query(
    "SELECT l_returnflag AS bucket, l_linestatus AS v, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS share FROM lineitem GROUP BY 1, 2"
)
def cond_categorical_pivot(spark, sf_dir):
    rows = conditional.bucketed(table(spark, sf_dir, "lineitem"), "l_returnflag", None)
    return rounded(conditional.frequencies(rows, "l_linestatus"), 9, "share")


EDGES_SQL = "SELECT list_sort(list_distinct([" + ", ".join(f"quantile_cont(l_extendedprice, {i / 10})" for i in range(11)) + "])) AS e FROM lineitem"


@query(
    f"""SELECT bucket, l_returnflag AS v, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY bucket), 9) AS share
FROM (SELECT CAST(len(list_filter(e[2:-2], lambda x: x < l_extendedprice)) AS INTEGER) AS bucket, l_returnflag FROM lineitem CROSS JOIN ({EDGES_SQL})) GROUP BY bucket, l_returnflag"""
)
def cond_numeric_pivot(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    rows = conditional.bucketed(df, "l_extendedprice", conditional.quantile_edges(df, "l_extendedprice"))
    return rounded(conditional.frequencies(rows, "l_returnflag"), 9, "share")


@query(
    f"""WITH r AS (SELECT l_returnflag AS bucket, l_quantity AS v FROM lineitem), p AS (SELECT bucket, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi FROM r GROUP BY bucket),
c AS (SELECT bucket, v, count(*) AS k, sum(count(*)) OVER (PARTITION BY bucket ORDER BY v) AS upto FROM r GROUP BY bucket, v),
j AS (SELECT c.bucket, v, n, mean, std, lo, hi, upto / n AS above, (upto - k) / n AS below, 1 / (1 + 0.3275911 * abs((v - mean) / (std * 1.4142135623730951))) AS t FROM c JOIN p ON c.bucket = p.bucket),
f AS (SELECT *, 0.5 * (1 + {ERF.format(x="(v - mean) / (std * 1.4142135623730951)")}) AS fn, (v - lo) / (hi - lo) AS fu FROM j),
d AS (SELECT bucket, max(n) AS n, max(mean) AS mean, max(std) AS std, 1 - max(greatest(above - fn, fn - below)) AS qn, 1 - max(greatest(above - fu, fu - below)) AS qu FROM f GROUP BY bucket)
SELECT bucket, n, round(mean, 6) AS mean, round(std, 6) AS std, CASE WHEN qn >= qu THEN 'normal' ELSE 'uniform' END AS family, round(greatest(qn, qu), 7) AS quality FROM d"""
)
def cond_numeric_target(spark, sf_dir):
    rows = conditional.bucketed(table(spark, sf_dir, "lineitem"), "l_returnflag", None)
    out = conditional.numeric_fits(rows, "l_quantity").select("bucket", F.col("count").alias("n"), "mean", "std", "family", "quality")
    return rounded(rounded(out, 6, "mean", "std"), 7, "quality")


@query("SELECT o_orderstatus AS v, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1")
def categorical_freq(spark, sf_dir):
    return rounded(patterns.value_shares(table(spark, sf_dir, "orders"), "o_orderstatus"), 9, "share")


@query("SELECT p_name AS v, min(p_partkey) AS first FROM part GROUP BY 1 ORDER BY 2 LIMIT 50")
def empirical_values(spark, sf_dir):
    return patterns.first_values(table(spark, sf_dir, "part").withColumn(ROW_ID, F.col("p_partkey")), "p_name")


# --- formats and anchors -------------------------------------------------------------------------------------------

HASHED = {
    "hex": ("sha256(CAST(o_orderkey AS VARCHAR))", lambda: F.sha2(F.col("o_orderkey").cast("string"), 256)),
    "bcrypt": ("'$bcrypt$2b$12$' || sha256(CAST(o_orderkey AS VARCHAR)) || '$'", lambda: F.concat(F.lit("$bcrypt$2b$12$"), F.sha2(F.col("o_orderkey").cast("string"), 256), F.lit("$"))),
    "word": ("o_orderstatus", lambda: F.col("o_orderstatus")),
}


@query(
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS col, count(*) AS n, avg(CAST(regexp_matches({e}, '^(\\$bcrypt\\$\\d+[a-z]?\\$\\d+\\$)([0-9a-f]+)(\\$)$') AS INT)) AS bcrypt_hash,"
        f" avg(CAST(regexp_matches({e}, '^[0-9a-f]{{32,128}}$') AS INT)) AS hex_hash, min(CASE WHEN regexp_matches({e}, '^[0-9a-f]{{32,128}}$') THEN {e} END) AS first_hex_hash FROM orders"
        for c, (e, _) in HASHED.items()
    )
)
def random_format(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(*(e().alias(c) for c, (_, e) in HASHED.items()))
    return formats.format_matches(df, list(HASHED)).select(F.col("column").alias("col"), "n", "bcrypt_hash", "hex_hash", "first_hex_hash")


MAIL_SQL = "'user' || c_custkey || '@' || ['example.com', 'example.net', 'mail.example.org'][c_custkey % 3 + 1]"


def mails(spark, sf_dir):
    domain = F.element_at(F.array(F.lit("example.com"), F.lit("example.net"), F.lit("mail.example.org")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("user"), "c_custkey", F.lit("@"), domain).alias("email"))


@query(f"SELECT c_custkey, regexp_extract({MAIL_SQL}, '^(.*)@', 1) AS email__local, CAST(list_position(['example.com', 'example.net', 'mail.example.org'], split_part({MAIL_SQL}, '@', -1)) - 1 AS SMALLINT) AS email__domain_idx FROM customer")
def email_split(spark, sf_dir):
    df = mails(spark, sf_dir)
    return formats.split_email(df, "email", formats.email_split(df, "email")["domain_dict"]).drop("email")


@query(f"SELECT c_custkey, {MAIL_SQL} AS email FROM customer")
def email_join(spark, sf_dir):
    df = mails(spark, sf_dir)
    domains = formats.email_split(df, "email")["domain_dict"]
    parts = formats.split_email(df, "email", domains).drop("email")
    return parts.select("c_custkey", formats.join_email(F.col("email__local"), F.col("email__domain_idx"), domains).alias("email"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, 1.0::DOUBLE AS ratio, (SELECT string_agg(DISTINCT split_part({MAIL_SQL}, '@', -1), ',' ORDER BY split_part({MAIL_SQL}, '@', -1)) FROM customer) AS domains FROM customer")
def email_domains(spark, sf_dir):
    return formats.email_domains(mails(spark, sf_dir), "email").withColumn("domains", F.array_join("domains", ","))


@query(
    all_of(
        "SELECT '{1}' AS col, count(DISTINCT {1}) = count(*) AND count({1}) = count(*) AS is_anchor FROM {0}",
        [("supplier", c) for c in COLUMNS["supplier"]] + [("customer", c) for c in COLUMNS["customer"]] + [("orders", c) for c in COLUMNS["orders"]],
    )
)
def anchor_columns(spark, sf_dir):
    return union([anchors.identity(table(spark, sf_dir, t)) for t in ("supplier", "customer", "orders")]).withColumnRenamed("column", "col")


@query("SELECT s_suppkey AS __row_id, s_suppkey, s_name FROM supplier")
def anchor_extract(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").withColumn(ROW_ID, F.col("s_suppkey"))
    return anchors.extract(df, ["s_suppkey", "s_name"], [])[0]


@query("SELECT CAST(sum(strlen(s_suppkey || ',' || s_name) + 1) + strlen('s_suppkey,s_name') + 1 AS BIGINT) AS csv_bytes, true AS packed FROM supplier")
def anchor_csv_bytes(spark, sf_dir):
    found = tables.anchor_savings(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_name"], 1 << 20, tables.working_folder(spark, "savings"))
    return spark.createDataFrame([(found["anchor_csv_bytes"], found["anchor_parquet_bytes"] > 0)], "csv_bytes long, packed boolean")


@query(
    """SELECT CAST(b AS INTEGER) AS base, CAST(sum(len(list_filter(d, lambda x: x = b))) AS BIGINT) AS n FROM (SELECT list_concat(list_transform(h, lambda c: CAST(('0x' || c) AS INTEGER) >> 2), list_transform(h, lambda c: CAST(('0x' || c) AS INTEGER) & 3)) AS d
FROM (SELECT string_split(hex(encode(url)), '') AS h FROM pages)) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS b) GROUP BY b"""
)
def fingerprint_bases(spark, sf_dir):
    from quarry.sources.fingerprint import base_counts

    return base_counts(table(spark, sf_dir, "pages"), F.col("url").cast("binary"))


@query(all_of("SELECT '{0}' AS col, count(*) AS n_total, round(avg({0}), 5) AS mean, min({0}) AS lo, max({0}) AS hi FROM lineitem", MEASURES))
def stream_moments(spark, sf_dir):
    """The table as a stream, run to its end."""
    import uuid

    from quarry.streaming.profile import stream_moments as moments

    static = table(spark, sf_dir, "lineitem")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/lineitem.parquet*")
    name = f"moments_{uuid.uuid4().hex}"
    run = moments(stream, MEASURES).writeStream.format("memory").outputMode("complete").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.table(name).select(F.col("column").alias("col"), "n_total", "mean", F.col("min").alias("lo"), F.col("max").alias("hi"))
    return rounded(out, 5, "mean")


# --- generators ----------------------------------------------------------------------------------------------------


def draw_sql(column: str, k: int | str = 0, key: str = "CAST(o_orderkey AS VARCHAR)") -> str:
    return f"(CAST(('0x' || substr(sha256('{column}|' || {key} || '|{k}'), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def generated(spark, sf_dir, column):
    return table(spark, sf_dir, "orders").select("o_orderkey", column.alias("v"))



def key():
    return F.col("o_orderkey").cast("string")


@query("SELECT o_orderkey, CAST(('0x' || substr(sha256('s' || o_orderkey), 1, 8)) AS BIGINT) AS v FROM orders")
def row_seed(spark, sf_dir):
    return generated(spark, sf_dir, random.row_seed(key(), "s"))


@query(f"SELECT o_orderkey, 3 + {draw_sql('u')} * 4 AS v FROM orders")
def gen_uniform(spark, sf_dir):
    return generated(spark, sf_dir, random.uniform_between(key(), "u", 3, 4))


@query(f"SELECT o_orderkey, round(2 - ln(1 - {draw_sql('e')}) * 5, 7) AS v FROM orders")
def gen_exponential(spark, sf_dir):
    return generated(spark, sf_dir, F.round(random.exponential(key(), "e", 2, 5), 7))


@query(f"SELECT o_orderkey, round(90 - (2 - ln(1 - {draw_sql('e')}) * 5), 7) AS v FROM orders")
def gen_exponential_reversed(spark, sf_dir):
    return generated(spark, sf_dir, F.round(rebuilding.draw(key(), "e", "exponential", {"loc": 2, "scale": 5, "reversed": True, "mirror_max": 90}), 7))


@query(f"SELECT o_orderkey, round(10 + sqrt(-2 * ln(1 - {draw_sql('n')})) * cos(6.283185307179586 * {draw_sql('n', 1)}) * 2, 7) AS v FROM orders")
def gen_normal(spark, sf_dir):
    return generated(spark, sf_dir, F.round(random.normal(key(), "n", 10, 2), 7))


@query(f"SELECT o_orderkey, round(least(greatest(10 + sqrt(-2 * ln(1 - {draw_sql('n')})) * cos(6.283185307179586 * {draw_sql('n', 1)}) * 2, 9.0), 11.5), 7) AS v FROM orders")
def gen_normal_clipped(spark, sf_dir):
    return generated(spark, sf_dir, F.round(rebuilding.draw(key(), "n", "normal", {"mean": 10, "std": 2, "clip": [9, 11.5]}), 7))


@query(f"SELECT o_orderkey, round(1 + pow({draw_sql('p')}, 1 / 2.5) * 3, 7) AS v FROM orders")
def gen_power_law(spark, sf_dir):
    return generated(spark, sf_dir, F.round(rebuilding.draw(key(), "p", "power_law", {"a": 2.5, "loc": 1, "scale": 3}), 7))


@query(f"SELECT o_orderkey, CASE WHEN {draw_sql('c')} < 0.5 THEN 'x' WHEN {draw_sql('c')} < 0.8 THEN 'y' ELSE 'z' END AS v FROM orders")
def gen_categorical(spark, sf_dir):
    return generated(spark, sf_dir, rebuilding.draw(key(), "c", "categorical_freq", {"frequencies": {"x": 0.5, "y": 0.3, "z": 0.2}}))


@query(f"SELECT o_orderkey, ['a', 'b', 'c', 'd', 'e'][CAST(floor({draw_sql('m')} * 5) AS INT) + 1] AS v FROM orders")
def gen_empirical(spark, sf_dir):
    return generated(spark, sf_dir, rebuilding.draw(key(), "m", "empirical", {"values": list("abcde")}))


@query("SELECT o_orderkey, '<' || substr(sha256('h|' || o_orderkey || '|h0') || sha256('h|' || o_orderkey || '|h1'), 1, 80) || '>' AS v FROM orders")
def gen_hex(spark, sf_dir):
    return generated(spark, sf_dir, random.formatted(key(), "h", {"prefix": "<", "suffix": ">", "body_type": "hex", "body_length": 80}))


@query(
    "SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS v"
    " FROM (SELECT o_orderkey, sha256('g|' || o_orderkey || '|h0') AS h FROM orders)"
)
def gen_uuid4(spark, sf_dir):
    return generated(spark, sf_dir, random.formatted(key(), "g", {"body_type": "uuid_v4", "body_length": 36}))


@query(
    "SELECT o_orderkey, 'PRD-' || array_to_string(list_transform(range(6), lambda i: substr('0123456789', CAST(('0x' || substr(h, i * 4 + 1, 4)) AS INT) % 10 + 1, 1)), '') AS v"
    " FROM (SELECT o_orderkey, sha256('d|' || o_orderkey || '|h0') AS h FROM orders)"
)
def gen_digits(spark, sf_dir):
    return generated(spark, sf_dir, random.formatted(key(), "d", {"prefix": "PRD-", "body_type": "digits", "body_length": 6}))


@query(f"SELECT o_orderkey, strftime(make_timestamp(CAST(trunc((1577836800 + {draw_sql('t')} * 31536000) * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '+0000' AS v FROM orders")
def gen_timestamp(spark, sf_dir):
    return generated(spark, sf_dir, rebuilding.timestamp_text(random.uniform_between(key(), "t", 1577836800, 31536000)))


# --- reconstruction ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def recon_functional_dep(spark, sf_dir):
    """Two chained lookups, rebuilt from the customer key and nation key alone."""
    df = geography(spark, sf_dir)
    return _rebuilt_geography(df).select("c_custkey", "nation", "region")


def _rebuilt_geography(df):
    from quarry.model import ColumnProfile, Pattern, Recipe, RecipeMetadata

    tables = {}
    for name, (a, b) in {"nation": ("c_nationkey", "n_name"), "region": ("n_name", "r_name")}.items():
        tables[name] = {str(r["key"]): r["value"] for r in dependency.lookup_table(df, a, b).collect()}
    anchor = df.select(F.col("c_custkey").alias(ROW_ID), "c_custkey", "c_nationkey")
    profiles = [ColumnProfile(n, t, k, 1, 1, 0) for n, t, k in (("c_custkey", "int64", "numeric"), ("c_nationkey", "int64", "numeric"), ("nation", "object", "string"), ("region", "object", "string"))]
    rules = [
        Pattern("c_custkey", "anchor_direct"), Pattern("c_nationkey", "anchor_direct"),
        Pattern("region", "functional_dep", source_column="nation", lookup_table=tables["region"], dependencies=["nation"]),
        Pattern("nation", "functional_dep", source_column="c_nationkey", lookup_table=tables["nation"], dependencies=["c_nationkey"]),
    ]
    recipe = Recipe(RecipeMetadata("geo", 0, 0, 0), profiles, ["c_custkey", "c_nationkey"], "", rules)
    return rebuilding.reconstruct(recipe, anchor)


@query(
    f"""SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN CASE WHEN {draw_sql('v')} < 0.9 THEN 'low' ELSE 'high' END ELSE CASE WHEN {draw_sql('v')} < 0.2 THEN 'low' ELSE 'high' END END AS v FROM orders"""
)
def recon_conditional(spark, sf_dir):
    from quarry.model import ColumnProfile, Pattern

    low, high = ({"distribution": "categorical_freq", "distribution_params": {"frequencies": {"low": s, "high": 1 - s}}} for s in (0.9, 0.2))
    buckets = [{"bucket_range": [0.0, 100000.0]} | low, {"bucket_range": [100000.0, 1e9]} | high]
    rule = Pattern("v", "conditional_distribution", source_column="o_totalprice", conditional_buckets=buckets)
    column = rebuilding._conditional(key(), rule, ColumnProfile("v", "object", "categorical", 1, 1, 0), F.col("o_totalprice"), "numeric")
    return generated(spark, sf_dir, column)


@query("SELECT l_orderkey, l_linenumber, CAST(len(list_filter([10.0, 20.0, 30.0], lambda e: e <= l_quantity)) AS INTEGER) AS bucket FROM lineitem")
def bucket_lookup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", conditional.lookup_bucket(F.col("l_quantity"), [1.0, 10.0, 20.0, 30.0, 50.0]).alias("bucket"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS v FROM lineitem")
def cast_whole(spark, sf_dir):
    from quarry.model import ColumnProfile

    profile = ColumnProfile("v", "int64", "numeric", 1, 1, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rebuilding.as_column(F.col("l_quantity") / 4, profile).alias("v"))


# --- validation ----------------------------------------------------------------------------------------------------

# a reproducible perturbation of orders: every seventh price rises by a tenth, every eleventh status changes
CHANGED_SQL = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 1.1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey, o_orderpriority FROM orders)"


def pair(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey", "o_orderpriority").withColumn(ROW_ID, F.col("o_orderkey"))
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") * 1.1).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))
    return a, a.withColumn("o_totalprice", price).withColumn("o_orderstatus", status)


@query("SELECT 'row_count' AS test_name, true AS passed, CAST(count(*) AS DOUBLE) AS metric, CAST(count(*) AS DOUBLE) AS threshold FROM orders")
def val_row_count(spark, sf_dir):
    t = validation.row_count(*pair(spark, sf_dir))
    return spark.createDataFrame([(t.test_name, t.passed, t.metric, t.threshold)], "test_name string, passed boolean, metric double, threshold double")


COMPARED = ["o_totalprice", "o_orderstatus", "o_custkey", "o_orderpriority"]


@query(
    f"""SELECT 'o_totalprice' AS col, count(*) FILTER (abs(a.o_totalprice - b.o_totalprice) > 1e-8 + 1e-5 * abs(b.o_totalprice)) AS differing FROM orders a JOIN {CHANGED_SQL} b ON a.o_orderkey = b.o_orderkey
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (a.o_orderstatus <> b.o_orderstatus) FROM orders a JOIN {CHANGED_SQL} b ON a.o_orderkey = b.o_orderkey
UNION ALL SELECT 'o_custkey', 0 UNION ALL SELECT 'o_orderpriority', 0"""
)
def val_anchor_exact(spark, sf_dir):
    a, b = pair(spark, sf_dir)
    return validation.anchor_differences(a, b, COMPARED).withColumnRenamed("column", "col")


@query(
    f"""WITH v AS (SELECT o_totalprice AS v, 1 AS a, 0 AS b FROM orders UNION ALL SELECT o_totalprice, 0, 1 FROM {CHANGED_SQL}), c AS (SELECT v, sum(a) AS a, sum(b) AS b FROM v GROUP BY v),
r AS (SELECT sum(a) OVER (ORDER BY v) AS ua, sum(b) OVER (ORDER BY v) AS ub, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM c)
SELECT 'o_totalprice' AS col, CAST(max(ta) AS BIGINT) AS n0, CAST(max(tb) AS BIGINT) AS n1, round(max(abs(ua / ta - ub / tb)), 9) AS d FROM r"""
)
def val_ks(spark, sf_dir):
    a, b = pair(spark, sf_dir)
    out = validation.two_sample_distances(validation.both_sides(a, b, {"o_totalprice": "numeric"}))
    return rounded(out.withColumnRenamed("column", "col"), 9, "d")


@query(f"SELECT round(abs(y - x) / abs(x), 9) AS metric, abs(y - x) / abs(x) <= 0.02 AS passed FROM (SELECT avg(o_totalprice) AS x FROM orders) CROSS JOIN (SELECT avg(o_totalprice) AS y FROM {CHANGED_SQL})")
def val_mean(spark, sf_dir):
    x, y = (profiling.moments(df, ["o_totalprice"]).first()["mean"] for df in pair(spark, sf_dir))
    t = validation.mean_test("o_totalprice", x, y, validation.Thresholds().mean_tolerance)
    return rounded(spark.createDataFrame([(t.metric, t.passed)], "metric double, passed boolean"), 9, "metric")


@query(f"SELECT round(a.r, 8) AS r_a, round(b.r, 8) AS r_b FROM (SELECT corr(o_totalprice, o_custkey) AS r FROM orders) a CROSS JOIN (SELECT corr(o_totalprice, o_custkey) AS r FROM {CHANGED_SQL}) b")
def val_corr(spark, sf_dir):
    a, b = (dependency.pearson(df, [("o_totalprice", "o_custkey")]).select(F.col("r").alias(n)) for df, n in zip(pair(spark, sf_dir), ("r_a", "r_b"), strict=True))
    return rounded(a.crossJoin(b), 8, "r_a", "r_b")


@query(
    f"""WITH a AS (SELECT o_orderstatus AS v, count(*) / (SELECT count(*) FROM orders) AS s FROM orders GROUP BY 1), b AS (SELECT o_orderstatus AS v, count(*) / (SELECT count(*) FROM orders) AS s FROM {CHANGED_SQL} GROUP BY 1)
SELECT 'o_orderstatus' AS col, count(*) FILTER (b.s IS NULL) AS missing, count(*) FILTER (a.s IS NULL) AS extra, round(max(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), 9) AS max_drift FROM a FULL JOIN b ON a.v = b.v"""
)
def val_cat_freq(spark, sf_dir):
    a, b = pair(spark, sf_dir)
    return rounded(validation.frequency_drift(a, b, "o_orderstatus").drop("worst").withColumnRenamed("column", "col"), 9, "max_drift")


@query("SELECT count(*) AS n, avg(CAST(regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$') AS INT)) AS matching, round(count(DISTINCT o_orderpriority) / count(*), 9) AS unique_ratio, round(avg(length(o_orderpriority)), 9) AS mean_length FROM orders")
def val_format(spark, sf_dir):
    out = validation.format_compliance(table(spark, sf_dir, "orders"), "o_orderpriority", "^[0-9]-[A-Z]+$")
    return rounded(out, 9, "unique_ratio", "mean_length")


@query(
    f"""WITH s AS ({cramers_sql("lineitem", "l_returnflag", "l_linestatus")}) SELECT col_a, col_b, round(v, 8) AS strength FROM s
UNION ALL SELECT 'l_quantity', 'l_extendedprice', round(abs(corr(l_quantity, l_extendedprice)), 8) FROM lineitem"""
)
def val_pair_strengths(spark, sf_dir):
    kinds = {"l_returnflag": "categorical", "l_linestatus": "categorical", "l_quantity": "numeric", "l_extendedprice": "numeric"}
    found = validation.pair_strengths(table(spark, sf_dir, "lineitem"), kinds, [("l_returnflag", "l_linestatus"), ("l_quantity", "l_extendedprice")])
    return rounded(spark.createDataFrame([(a, b, s) for (a, b), s in found.items()], "col_a string, col_b string, strength double"), 8, "strength")


@query(
    f"""WITH t AS (SELECT a.o_totalprice AS x, b.o_totalprice AS y, a.o_orderstatus AS s, b.o_orderstatus AS u FROM orders a JOIN {CHANGED_SQL} b ON a.o_orderkey = b.o_orderkey),
r AS (SELECT (SELECT count(*) FROM orders) = (SELECT count(*) FROM {CHANGED_SQL}) AS rows, count(*) FILTER (abs(x - y) > 1e-8 + 1e-5 * abs(y)) = 0 AS price, count(*) FILTER (s <> u) = 0 AS status,
abs(avg(y) - avg(x)) / abs(avg(x)) <= 0.02 AS mean, (SELECT max(abs(coalesce(p, 0) - coalesce(q, 0))) <= 0.03 AND count(p) = count(*) AND count(q) = count(*)
FROM (SELECT s AS v, count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY s) FULL JOIN (SELECT u AS v, count(*) / (SELECT count(*) FROM t) AS q FROM t GROUP BY u) USING (v)) AS shares FROM t)
SELECT round(100.0 * (2 * (CAST(rows AS INT) + CAST(price AS INT) + CAST(status AS INT)) + CAST(mean AS INT) + CAST(shares AS INT)) / 8, 2)::DOUBLE AS score,
CAST(rows AS BIGINT) + CAST(price AS INT) + CAST(status AS INT) + CAST(mean AS INT) + CAST(shares AS INT) AS passed FROM r"""
)
def val_score(spark, sf_dir):
    a, b = pair(spark, sf_dir)
    structural = [validation.row_count(a, b), *validation.anchors_exact(a, b, ["o_totalprice", "o_orderstatus"])]
    x, y = (profiling.moments(df, ["o_totalprice"]).first()["mean"] for df in (a, b))
    t = validation.Thresholds()
    statistical = [validation.mean_test("o_totalprice", x, y, t.mean_tolerance), validation.frequency_test(validation.frequency_drift(a, b, "o_orderstatus").first(), t.frequency_tolerance)]
    r = validation.report(structural, statistical)
    return spark.createDataFrame([(r.overall_score, r.passed_count)], "score double, passed long")


SCHEMAS = [("orders", "orders"), ("orders", "customer"), ("nation", "region")]


@query(
    all_of(
        "SELECT '{0}' AS a, '{1}' AS b, count(*) FILTER (x.column_name IS NULL OR y.column_name IS NULL) = 0 AS passed FROM (DESCRIBE {0}) x FULL JOIN (DESCRIBE {1}) y ON x.column_name = y.column_name",
        SCHEMAS,
    )
)
def val_schema(spark, sf_dir):
    found = [(a, b, validation.schema_match(table(spark, sf_dir, a), table(spark, sf_dir, b)).passed) for a, b in SCHEMAS]
    return spark.createDataFrame(found, "a string, b string, passed boolean")


# lineitem with prices that rise by a tenth for every seventh order
RISEN_SQL = "(SELECT l_quantity, CASE WHEN l_orderkey % 7 = 0 THEN l_extendedprice * 1.1 ELSE l_extendedprice END AS l_extendedprice FROM lineitem)"


def risen(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return a, a.withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 7 == 0, F.col("l_extendedprice") * 1.1).otherwise(F.col("l_extendedprice")))


@query(
    f"""WITH v AS (SELECT l_extendedprice AS v, 1 AS a, 0 AS b FROM lineitem UNION ALL SELECT l_extendedprice, 0, 1 FROM {RISEN_SQL}), c AS (SELECT v, sum(a) AS a, sum(b) AS b FROM v GROUP BY v),
r AS (SELECT sum(a) OVER (ORDER BY v) AS ua, sum(b) OVER (ORDER BY v) AS ub, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM c), d AS (SELECT max(abs(ua / ta - ub / tb)) AS d, max(ta) / 2 AS m FROM r)
SELECT round(d, 9) AS distance, d <= 0.05 AS passed, round(least(1, greatest(0, (SELECT 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * m * d * d)) FROM range(1, 101) t(k)))), 9)::DOUBLE AS p_value FROM d"""
)
def val_ks_test(spark, sf_dir):
    """The decision by distance, and the p-value of its asymptotic series (both tables have over 2,000 rows)."""
    r = validation.two_sample_distances(validation.both_sides(*risen(spark, sf_dir), {"l_extendedprice": "numeric"})).first()
    t = validation.ks_test("l_extendedprice", r["n0"], r["n1"], r["d"], 0.0, validation.Thresholds())
    out = spark.createDataFrame([(t.metric, t.passed, validation.ks_pvalue(r["d"], r["n0"], r["n1"]))], "distance double, passed boolean, p_value double")
    return rounded(out, 9, "distance", "p_value")


@query(
    f"""SELECT CASE WHEN abs(x) < 0.1 THEN NULL ELSE round(abs(abs(x) - abs(y)), 8) END AS metric, abs(x) < 0.1 OR abs(abs(x) - abs(y)) <= 0.05 AS passed
FROM (SELECT corr(l_quantity, l_extendedprice) AS x FROM lineitem) CROSS JOIN (SELECT corr(l_quantity, l_extendedprice) AS y FROM {RISEN_SQL})"""
)
def val_correlation_preserved(spark, sf_dir):
    chosen, kinds = ("l_quantity", "l_extendedprice"), {"l_quantity": "numeric", "l_extendedprice": "numeric"}
    x, y = (validation.pair_strengths(df, kinds, [chosen])[chosen] for df in risen(spark, sf_dir))
    t = validation.correlation_test(chosen, x, y, validation.Thresholds())
    return rounded(spark.createDataFrame([(t.metric, t.passed)], "metric double, passed boolean"), 8, "metric")


@query(
    "WITH s AS ("
    + all_of("SELECT '{0}' AS col_a, '{1}' AS col_b, abs(corr({0}, {1})) AS s FROM lineitem", PAIRS)
    + ") SELECT col_a, col_b, row_number() OVER (ORDER BY s DESC) AS rank FROM s QUALIFY row_number() OVER (ORDER BY s DESC) <= 3"
)
def val_top_pairs(spark, sf_dir):
    found = validation.pair_strengths(table(spark, sf_dir, "lineitem"), dict.fromkeys(MEASURES, "numeric"), PAIRS)
    return spark.createDataFrame([(*p, i) for i, p in enumerate(validation.strongest_pairs(found, 0.0, 3), 1)], "col_a string, col_b string, rank long")


MIXED_TEXT_SQL = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'n' || o_orderkey WHEN 2 THEN '' ELSE '-' || o_orderkey || '.5' END"


@query(f"SELECT o_orderkey, TRY_CAST({MIXED_TEXT_SQL} AS DOUBLE) AS v FROM orders")
def coerced_numbers(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    rest = F.col("o_orderkey") % 4
    text = F.when(rest == 0, k).when(rest == 1, F.concat(F.lit("n"), k)).when(rest == 2, "").otherwise(F.concat(F.lit("-"), k, F.lit(".5")))
    df = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return df.select("o_orderkey", validation.as_number(df, "t", "numeric").alias("v"))


# --- tables in and out, whole profiles, and round trips through files ----------------------------------------------


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    folder = tables.working_folder(spark, "csv")
    df = table(spark, sf_dir, "supplier").select(*COLUMNS["supplier"])
    tables.write_csv(df.withColumn(ROW_ID, F.col("s_suppkey")), folder)
    return tables.read_csv(spark, folder).select(*(F.col(f.name).cast(f.dataType) for f in df.schema))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def anchors_round_trip(spark, sf_dir):
    folder = tables.working_folder(spark, "anchors")
    tables.write_anchors(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), folder, "zstd", 19)
    return tables.read_anchors(spark, folder)


def profile_sql(name: str, numbers: list[str]) -> str:
    """Type, counts, and mean and median of the numeric columns, of a table's profile."""
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS col, CASE WHEN typeof(any_value({c})) IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN typeof(any_value({c})) LIKE 'TIMESTAMP%' THEN 'datetime'"
        f" WHEN count(DISTINCT {c}) / count(*) < 0.05 THEN 'categorical' ELSE 'string' END AS column_type, count(*) AS n_total, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique,"
        f" count(DISTINCT {c}) = count(*) AS is_anchor, "
        + (f"round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4)" if c in numbers else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE)")
        + f" AS median FROM {name}"
        for c in COLUMNS[name]
    )


def profile_rows(spark, profiles):
    rows = []
    for p in profiles:
        mean, median = (p.numeric_stats.mean, p.numeric_stats.q50) if p.numeric_stats else (None, None)
        rows.append((p.name, p.column_type.value, p.n_total, p.n_null, p.n_unique, p.is_anchor_candidate, mean, median))
    out = spark.createDataFrame(rows, "col string, column_type string, n_total long, n_null long, n_unique long, is_anchor boolean, mean double, median double")
    return rounded(out, 4, "mean", "median")


@query(profile_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def profile_table(spark, sf_dir):
    return profile_rows(spark, profiling.profile(table(spark, sf_dir, "orders").select(*COLUMNS["orders"])))


@query(profile_sql("supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]))
def recipe_round_trip(spark, sf_dir):
    """A recipe of supplier, rendered as Markdown and parsed again."""
    from quarry.model import Pattern, Recipe, RecipeMetadata
    from quarry.sources import recipes

    profiles = profiling.profile(table(spark, sf_dir, "supplier").select(*COLUMNS["supplier"]))
    rules = [Pattern(p.name, "anchor_direct") for p in profiles]
    text = recipes.render(Recipe(RecipeMetadata("supplier", profiles[0].n_total, 0, 0), profiles, [p.name for p in profiles], "anchors.parquet", rules))
    return profile_rows(spark, recipes.parse(text).schema_columns)


@query(f"SELECT c_custkey, {MAIL_SQL} AS email, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def files_round_trip(spark, sf_dir):
    """Compressed to a recipe and anchors, and rebuilt from the files: split addresses, and names by their keys."""
    from quarry.plans import pipeline

    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    df = mails(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(nation, "c_nationkey")
    folder = tables.working_folder(spark, "files").removeprefix("file:")
    made = pipeline.compress_table(df.select("c_custkey", "email", "c_nationkey", "n_name"), folder, "mails", 1 << 20, manual_anchors=["c_nationkey"])
    return pipeline.rebuild(spark, made.recipe_path).select("c_custkey", "email", "c_nationkey", "n_name")


LINKED = [*MEASURES, "l_returnflag", "l_linestatus"]
FLAGS = ["l_returnflag", "l_linestatus"]


@query(
    "SELECT * FROM ("
    + all_of("SELECT '{0}' AS col_a, '{1}' AS col_b, 'pearson' AS kind, round(abs(corr({0}, {1})), 8) AS strength FROM lineitem", PAIRS)
    + f"\nUNION ALL SELECT col_a, col_b, 'cramers_v', round(v, 8) FROM ({cramers_sql('lineitem', 'l_returnflag', 'l_linestatus')})\nUNION ALL\n"
    + all_of(
        "SELECT '{0}', '{1}', 'anova', round(1 - sum(n * v) / (SELECT count(*) * var_pop({0}) FROM lineitem), 8) FROM (SELECT count(*) AS n, var_pop({0}) AS v FROM lineitem GROUP BY {1})",
        [(m, c) for m in MEASURES for c in FLAGS],
    )
    + ") WHERE strength >= 0"
)
def detect_correlations(spark, sf_dir):
    from quarry.model import ColumnProfile

    df = table(spark, sf_dir, "lineitem").select(*LINKED)
    profiles = [ColumnProfile(c, "object", "categorical" if c in FLAGS else "numeric", 1, 1, 0) for c in LINKED]
    found = dependency.correlations(df, profiles, 0.0)
    return rounded(spark.createDataFrame([(c.col_a, c.col_b, c.correlation_type, c.strength) for c in found], "col_a string, col_b string, kind string, strength double"), 8, "strength")


@query(
    "SELECT * FROM (SELECT CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'False' END AS v, count(*) AS n FROM orders GROUP BY 1)"
)
def boolean_counts(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select((F.col("o_totalprice") > 100000).alias("big"))
    return profiling.top_values(profiling.labelled_counts(df)).select("v", "n")


@query(all_of("SELECT '{0}' AS col, least(5, count(DISTINCT {0})) AS n, true AS all_there FROM orders", COLUMNS["orders"]))
def profile_examples(spark, sf_dir):
    """How many examples each column shows, and that each of them is a value of the column."""
    counts = profiling.labelled_counts(table(spark, sf_dir, "orders").select(*COLUMNS["orders"]))
    shown = profiling.examples(counts).select("column", F.explode("values").alias("v"))
    there = shown.join(counts.select("column", "v", F.lit(True).alias("there")), ["column", "v"], "left")
    return there.groupBy(F.col("column").alias("col")).agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce("there", F.lit(False))).alias("all_there"))


NAMED = ["documents", "events", "embeddings", "pages", "orders"]


@query(all_of("SELECT '{0}' AS tab, column_name AS col, regexp_matches(lower(column_name), '^((.*_)?(id|uuid|uid|pk))$') AS id_like FROM (DESCRIBE {0})", NAMED))
def id_like_names(spark, sf_dir):
    rows = [(t, c, formats.looks_like_id(c)) for t in NAMED for c in table(spark, sf_dir, t).columns]
    return spark.createDataFrame(rows, "tab string, col string, id_like boolean")


@query(
    "SELECT 'hex' AS col, '' AS prefix, '' AS suffix, max(length(v)) AS body_length, 'hex_hash' AS detected_as FROM (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS v FROM orders) WHERE regexp_matches(v, '^[0-9a-f]{32,128}$')\n"
    "UNION ALL SELECT 'bcrypt', regexp_extract(max(v), '^(\\$bcrypt\\$\\d+[a-z]?\\$\\d+\\$)', 1), right(max(v), 1), max(length(regexp_extract(v, '\\$([0-9a-f]+)\\$$', 1))), 'bcrypt_hash'"
    " FROM (SELECT '$bcrypt$2b$12$' || sha256(CAST(o_orderkey AS VARCHAR)) || '$' AS v FROM orders)"
)
def random_format_spec(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(*(e().alias(c) for c, (_, e) in HASHED.items()))
    rows = [(c, s["prefix"], s["suffix"], s["body_length"], s["detected_as"]) for c, s in formats.random_formats(df, list(HASHED)).items()]
    return spark.createDataFrame(rows, "col string, prefix string, suffix string, body_length long, detected_as string")


# --- whole pipeline ------------------------------------------------------------------------------------------------


@query()
def flagship(spark, sf_dir):
    """Describes orders, rebuilds the table from anchors and patterns, and compares: a row per test."""
    from quarry.model import Recipe, RecipeMetadata
    from quarry.plans.pipeline import describe

    rows = table(spark, sf_dir, "orders").withColumn(ROW_ID, F.col("o_orderkey")).cache()
    profiles, found, names, _ = describe(rows)
    stored, columns = anchors.extract(rows, names, found)
    recipe = Recipe(RecipeMetadata("orders", profiles[0].n_total, 0, 0), profiles, columns, "", found)
    rebuilt = rebuilding.reconstruct(recipe, stored).cache()
    checked = [c for c in anchors.for_validation(columns, rows.columns) if c != ROW_ID]
    report = validation.validate(rows, rebuilt, checked, formats=anchors.random_format_regexes(found))
    rebuilt.unpersist()
    rows.unpersist()
    return validation.report_frame(spark, report)
