"""Queries on per-epoch figures, statistics, histograms, filters and downsampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanax.operators import filters, grid
from almanax.plans.adapter import OBS, observations

_SAT = f"""WITH {OBS},
sat AS (SELECT t_ms, sys, prn, avg(CASE WHEN code LIKE 'S%' AND value > 0 THEN value END) AS snr FROM obs GROUP BY ALL)"""
_REGISTRY = "reg AS (SELECT sys, code, row_number() OVER (PARTITION BY sys ORDER BY min(t_ms), code) AS ord FROM obs GROUP BY sys, code)"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Averages to 6 digits, as engines add in different orders."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def grid_system_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.grid_systems(observations(spark, sf_dir)), "snr")


def grid_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.grid_epochs(observations(spark, sf_dir)), "mean_snr")


def satellite_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.satellite_snr(observations(spark, sf_dir)), "snr")


def band_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.band_snr(observations(spark, sf_dir))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.statistics(observations(spark, sf_dir)), "mean_sats", "mean_snr")


def cn0_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cn0_histogram(observations(spark, sf_dir))


def system_snr_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.system_snr_histogram(observations(spark, sf_dir))


def code_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.code_registry(observations(spark, sf_dir))


def ordered_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.ordered_codes(observations(spark, sf_dir))


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.facets(observations(spark, sf_dir))


def type_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.type_matrix(observations(spark, sf_dir))


def chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.chart_rows(observations(spark, sf_dir), most=100)


def strided_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.strided(observations(spark, sf_dir).select("t_ms").distinct(), most=100)


def satellite_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.satellite_heatmap(observations(spark, sf_dir), most=100), "snr")


def median_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the raw event times, whose gaps are below the bound."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"))
    return grid.median_interval(e)


EXCLUDING = filters.FilterState(systems=("S",), prns=("G03", "R05"), types=("L",), bands=("2",), signals={"E": ("1C",)}, start_ms=1704240000000, end_ms=1705968000000)
DECIMATED = filters.FilterState(interval_s=10_000.0)
SPARSE = filters.FilterState(sparse_percent=40.0, systems=("I",))


def filter_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filters(observations(spark, sf_dir), EXCLUDING)


def filter_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filters(observations(spark, sf_dir), DECIMATED)


def filter_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellites that stay when codes, a system and a week's first half go, with the number of their values that are left, 0 too."""
    obs, f = observations(spark, sf_dir), filters.FilterState(systems=("R",), types=("C", "S"), bands=("2",), end_ms=1_705_500_000_000)
    left = filters.apply_filters(obs, f).groupBy("t_ms", "sys", "prn").agg(F.count("value").alias("n"))
    return filters.satellite_epochs(obs, f).join(left, ["t_ms", "sys", "prn"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def filter_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filters(observations(spark, sf_dir), SPARSE)


def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and epochs of each file of a split export."""
    rows = filters.with_chunks(observations(spark, sf_dir), 50_000_000.0)
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("t_ms").alias("epochs"))


QUERIES = {
    f.__name__: f
    for f in (
        grid_system_epochs, grid_epochs, satellite_snr, band_snr, statistics, cn0_histogram, system_snr_histogram, code_registry, ordered_codes, facets, type_matrix, chart_rows, strided_epochs,
        satellite_heatmap, median_interval, filter_exclusions, filter_decimated, filter_satellites, filter_sparse, split_chunks,
    )
}

_BINS = "SELECT sys, low, coalesce(n, 0) AS n FROM (SELECT DISTINCT sys FROM h) s CROSS JOIN (SELECT unnest(range(0, {end}, {width})) AS low) b LEFT JOIN h USING (sys, low)"
_STEP = "e AS (SELECT t_ms, row_number() OVER (ORDER BY t_ms) - 1 AS i, greatest(1, ceil(count(*) OVER () / 100.0)) AS step FROM (SELECT DISTINCT t_ms FROM obs))"
_GRID = f"{_SAT}, g AS (SELECT t_ms, count(*) AS total_sats, avg(snr) AS mean_snr FROM sat GROUP BY 1), n AS (SELECT sys, t_ms, count(*) AS sats, avg(snr) AS snr FROM sat GROUP BY ALL)"
_GREEDY = """RECURSIVE {obs}, ep AS (SELECT t_ms, lead(t_ms) OVER (ORDER BY t_ms) AS nx FROM (SELECT DISTINCT t_ms FROM obs)),
w(t_ms, nx, last) AS (SELECT * FROM (SELECT t_ms, nx, t_ms FROM ep ORDER BY t_ms LIMIT 1) UNION ALL SELECT e.t_ms, e.nx, CASE WHEN e.t_ms - w.last >= {least} THEN e.t_ms ELSE w.last END FROM w JOIN ep e ON e.t_ms = w.nx)"""

ORACLE_SQL = {
    "grid_system_epochs": f"{_GRID} SELECT t_ms, sys, coalesce(sats, 0) AS sats, round(snr, 6) AS snr FROM (SELECT DISTINCT t_ms FROM g) CROSS JOIN (SELECT DISTINCT sys FROM sat) LEFT JOIN n USING (t_ms, sys)",
    "grid_epochs": f"{_GRID} SELECT t_ms, total_sats, round(mean_snr, 6) AS mean_snr FROM g",
    "satellite_snr": f"{_SAT} SELECT t_ms, sys, prn, round(snr, 6) AS snr FROM sat WHERE snr IS NOT NULL",
    "band_snr": f"WITH {OBS}, {_REGISTRY} SELECT t_ms, prn, substr(code, 2, 1) AS band, max_by(value, ord) AS snr FROM obs JOIN reg USING (sys, code) WHERE code LIKE 'S%' AND value > 0 GROUP BY ALL",
    "statistics": f"""{_GRID}, t AS (SELECT DISTINCT t_ms FROM g ORDER BY t_ms LIMIT 2), u AS (SELECT sys, count(DISTINCT prn) AS n FROM sat GROUP BY 1)
        SELECT (SELECT count(*) FROM g) AS epochs, (SELECT min(t_ms) FROM g) AS start_ms, (SELECT max(t_ms) FROM g) AS end_ms, (SELECT (max(t_ms) - min(t_ms)) / 1000.0 FROM g) AS duration,
               (SELECT CASE WHEN count(*) = 2 THEN (max(t_ms) - min(t_ms)) / 1000.0 END FROM t) AS interval, (SELECT CAST(sum(n) AS BIGINT) FROM u) AS unique_sats,
               (SELECT string_agg(sys || ':' || n, ',' ORDER BY instr('GRECJIS', sys)) FROM u) AS per_system, (SELECT round(avg(total_sats), 6) FROM g) AS mean_sats, (SELECT round(avg(snr), 6) FROM sat) AS mean_snr""",
    "cn0_histogram": f"{_SAT}, h AS (SELECT sys, CAST(least(floor(snr / 5), 11) * 5 AS INT) AS low, count(*) AS n FROM sat WHERE snr IS NOT NULL GROUP BY ALL) " + _BINS.format(end=60, width=5).replace("AS low)", "::INT AS low)"),
    "system_snr_histogram": f"{_GRID}, h AS (SELECT sys, CAST(least(floor(snr / 2), 29) * 2 AS INT) AS low, count(*) AS n FROM n WHERE snr > 0 GROUP BY ALL), f AS ("
    + _BINS.format(end=60, width=2).replace("AS low)", "::INT AS low)")
    + ") SELECT *, CAST(sum(n) OVER (PARTITION BY low ORDER BY instr('GRECJIS', sys)) AS BIGINT) AS stacked FROM f",
    "code_registry": f"WITH {OBS}, {_REGISTRY} SELECT sys, code, CAST(ord AS INT) AS ord FROM reg",
    "ordered_codes": f"WITH {OBS} SELECT sys, code, CAST(row_number() OVER (PARTITION BY sys ORDER BY substr(code, 2, 1), substr(code, 1, 1), code) AS INT) AS place FROM (SELECT DISTINCT sys, code FROM obs)",
    "facets": f"""WITH {OBS}, {_REGISTRY}, s AS (SELECT sys, substr(code, 2, 2) AS sig, min(ord) AS ord FROM reg GROUP BY ALL)
        SELECT sys, (SELECT string_agg(DISTINCT prn, ',' ORDER BY prn) FROM obs o WHERE o.sys = r.sys) AS prns, (SELECT string_agg(sig, ',' ORDER BY ord) FROM s WHERE s.sys = r.sys) AS signals,
               (SELECT string_agg(DISTINCT substr(code, 2, 1), ',' ORDER BY substr(code, 2, 1)) FROM obs o WHERE o.sys = r.sys) AS bands FROM (SELECT DISTINCT sys FROM obs) r""",
    "type_matrix": f"WITH {OBS}, c AS (SELECT DISTINCT sys, code FROM obs) SELECT sys, "
    + ", ".join(f"coalesce(string_agg(code, ' ' ORDER BY code) FILTER (code LIKE '{t}%'), '') AS codes_{t.lower()}" for t in "CLDS")
    + " FROM c GROUP BY sys",
    "chart_rows": f"""{_GRID}, {_STEP}, r AS (SELECT i // CAST(step AS BIGINT) AS k, list(t_ms ORDER BY t_ms) AS times, sum(total_sats) AS sats, avg(mean_snr) AS snr, count(*) AS size FROM g JOIN e USING (t_ms) GROUP BY 1)
        SELECT times[size // 2 + 1] AS t_ms, CAST(floor(sats / size + 0.5) AS BIGINT) AS total, floor(snr * 10 + 0.5) / 10 AS snr FROM r""",
    "strided_epochs": f"WITH {OBS}, {_STEP} SELECT t_ms FROM e WHERE i % step = 0",
    "satellite_heatmap": f"{_SAT}, {_STEP} SELECT t_ms, prn, round(snr, 6) AS snr FROM sat JOIN e USING (t_ms) WHERE i % step = 0 AND snr IS NOT NULL",
    "median_interval": """WITH t AS (SELECT DISTINCT (epoch_us(ts) // 1000) AS t FROM events ORDER BY t LIMIT 20), d AS (SELECT (t - lag(t) OVER (ORDER BY t)) / 1000.0 AS d FROM t),
        k AS (SELECT list(d ORDER BY d) AS l FROM d WHERE d > 0 AND d < 300) SELECT l[len(l) // 2 + 1] AS interval FROM k""",
    "filter_exclusions": f"""WITH {OBS} SELECT * FROM obs WHERE t_ms BETWEEN 1704240000000 AND 1705968000000 AND sys <> 'S' AND prn NOT IN ('G03', 'R05') AND code NOT LIKE 'L%' AND substr(code, 2, 1) <> '2'
        AND NOT (sys = 'E' AND substr(code, 2) = '1C')""",
    "filter_satellites": f"""WITH {OBS}, b AS (SELECT * FROM obs WHERE sys <> 'R' AND t_ms <= 1705500000000), k AS (SELECT * FROM b WHERE substr(code, 1, 1) NOT IN ('C', 'S') AND substr(code, 2, 1) <> '2'),
n AS (SELECT t_ms, prn, count(value) AS n FROM k GROUP BY ALL), e AS (SELECT DISTINCT t_ms, sys, prn FROM b WHERE sys IN (SELECT sys FROM k))
SELECT t_ms, sys, prn, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (t_ms, prn)""",
    "filter_decimated": "WITH " + _GREEDY.format(obs=OBS, least=10_000_000 - 1) + " SELECT t_ms, sys, prn, code, value FROM obs WHERE t_ms IN (SELECT t_ms FROM w WHERE t_ms = last)",
    "filter_sparse": f"""WITH {OBS}, k AS (SELECT * FROM obs WHERE sys <> 'I'), c AS (SELECT sys, code, count(value) AS n FROM k GROUP BY ALL)
        SELECT t_ms, sys, prn, code, value FROM k WHERE (sys, code) IN (SELECT (sys, code) FROM c WHERE n >= ceil((SELECT count(DISTINCT t_ms) FROM k) * 40.0 / 100))""",
    "split_chunks": "WITH " + _GREEDY.format(obs=OBS, least=50_000_000) + ", s AS (SELECT t_ms AS chunk FROM w WHERE t_ms = last) SELECT (SELECT max(chunk) FROM s WHERE chunk <= t_ms) AS chunk, count(*) AS n_rows, count(DISTINCT t_ms) AS epochs FROM obs GROUP BY 1",
}
