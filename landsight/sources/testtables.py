"""Adapters that shape the driver's test tables into this library's inputs.

The test data is TPC-H-like; these builders derive, with ordinary joins and
column expressions, the shapes the library works on:

* ``boundary``      country boundaries (``ISO_A3``, ``ADMIN``) from ``nation``
* ``observation``   raw all-text indicator rows from ``lineitem`` x ``supplier`` x ``nation``
* ``analysis_log``  the risk log from ``events``
* ``request``       coordinate requests from ``events`` (every event is a request)
* ``reply``         raw model replies around every whole text of ``documents``

Every row of the source tables is used, so the work grows with the data.
The same shapes are written as SQL in ``landsight.registry.oracle`` for the
DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_MODEL_CONFIG, ModelConfig


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation_code(nationkey) -> F.Column:
    return F.concat(F.lit("N"), F.lpad(nationkey.cast("string"), 2, "0"))


def boundary_code(nationkey) -> F.Column:
    """The boundary code of a nation; nations 23+ share the unmatched ``-99``."""
    return F.when(nationkey >= 23, F.lit("-99")).otherwise(_nation_code(nationkey))


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries: one row per nation (``ISO_A3``, ``ADMIN``)."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        boundary_code(F.col("n_nationkey")).alias("ISO_A3"),
        F.col("n_name").alias("ADMIN"),
    )


def observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw indicator rows, all text: dataset, Entity, Code, Year, value.

    Deliberate dirt: NULL / ``OWID_WRL`` / two-letter / tab-padded codes, a text
    year, and NULL / ``nan`` / ``abc`` values.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = li.join(su, li.l_suppkey == su.s_suppkey).join(na, F.col("s_nationkey") == na.n_nationkey)
    ln = F.col("l_linenumber")
    nk = F.col("n_nationkey")
    q = F.col("l_quantity")
    dataset = (
        F.when(ln % 3 == 0, F.lit("annual_deforestation"))
        .when(ln % 3 == 1, F.lit("share_degraded_land"))
        .otherwise(F.lit("share_protected_land"))
    )
    code = (
        F.when(ln == 7, F.lit(None).cast("string"))
        .when(ln == 6, F.lit("OWID_WRL"))
        .when(nk > 20, F.lit("US"))
        .when(ln == 5, F.concat(F.lit("\t"), _nation_code(nk), F.lit(" ")))
        .otherwise(_nation_code(nk))
    )
    year = F.when(q == 50, F.lit("n/a")).otherwise(F.year("l_shipdate").cast("string"))
    value = (
        F.when(q == 1, F.lit(None).cast("string"))
        .when(q == 2, F.lit("nan"))
        .when(q == 3, F.lit("abc"))
        .otherwise(F.col("l_extendedprice").cast("string"))
    )
    return j.select(
        dataset.alias("dataset"),
        F.col("n_name").alias("Entity"),
        code.alias("Code"),
        year.alias("Year"),
        value.alias("value"),
    )


# Consecutive events share a location: 25 log entries per location, and the
# requests cover twice as many locations (half of them in the log).  The number
# of locations grows with the events table.
LOG_ENTRIES_PER_KEY = 25


# Locations repeat on a grid of this many steps; every further round over the
# grid is moved north by its own fraction of a step, so keys stay distinct.
GRID_STEPS = 612_000


def _key_coordinates(key) -> list:
    turn = F.floor(key / GRID_STEPS).cast("double")
    lat = ((key * 37) % 17000).cast("double") / 100.0 - 85.0 + turn / (turn + 1.0) / 100.0
    lon = ((key * 91) % 36000).cast("double") / 100.0 - 180.0
    zoom = (F.lit(1) + key % 20).cast("int")
    return [lat.alias("latitude"), lon.alias("longitude"), zoom.alias("zoom")]


def utc_instant(ts) -> F.Column:
    """The test tables' timestamps have no zone; they are taken as UTC whatever
    the session's zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def analysis_log(
    spark: SparkSession, sf_dir: str, config: ModelConfig = DEFAULT_MODEL_CONFIG
) -> DataFrame:
    """The analysis log: one location per 25 consecutive events."""
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    danger = (
        F.when(et == "error", F.lit("Y"))
        .when(et == "purchase", F.lit("YES"))
        .when(et == "signup", F.lit(None).cast("string"))
        .otherwise(F.lit("N"))
    )
    return ev.select(
        F.col("event_id").alias("id"),
        utc_instant(F.col("ts")).alias("timestamp"),
        *_key_coordinates(F.floor(F.col("event_id") / LOG_ENTRIES_PER_KEY)),
        F.concat(et, F.lit(" "), F.col("props")).alias("image_description"),
        F.lit(config.image_prompt.strip()).alias("image_prompt"),
        F.lit(config.image_model).alias("image_model"),
        et.alias("text_description"),
        F.lit(config.text_prompt.strip()).alias("text_prompt"),
        F.lit(config.text_model).alias("text_model"),
        danger.alias("danger"),
    )


def request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate requests: every event is one; twice as many locations as the
    log, half of them in the log."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("request_id"),
        *_key_coordinates(F.floor(F.col("event_id") * 2 / LOG_ENTRIES_PER_KEY)),
    )


def coordinate_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests as the workflow form takes them: a magnitude and a
    hemisphere letter per axis."""
    r = request(spark, sf_dir)
    lat, lon = F.col("latitude"), F.col("longitude")
    return r.select(
        "request_id",
        F.abs(lat).alias("lat_abs"),
        F.when(lat >= 0, F.lit("N")).otherwise(F.lit("S")).alias("lat_dir"),
        F.abs(lon).alias("lon_abs"),
        F.when(lon >= 0, F.lit("E")).otherwise(F.lit("W")).alias("lon_dir"),
        "zoom",
    )


def json_text(text) -> F.Column:
    """A text inside a JSON string: quotes and backslashes escaped, control
    characters as spaces."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.regexp_replace(escaped, r"[\x00-\x1F]", " ")


def reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies of eight kinds, each around a whole document text: as a
    justification, inside a fence, after an object, or as plain text."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 8
    text = F.col("text")
    quoted = F.concat(F.lit('"'), json_text(text), F.lit('"'))
    raw = (
        F.when(k == 0, F.concat(F.lit('{"danger": "y", "justification": '), quoted, F.lit("}")))
        .when(k == 1, F.concat(F.lit('```json\n{"danger": "N", "justification": '), quoted, F.lit("}\n```")))
        .when(k == 2, F.concat(F.lit('{"danger": null, "justification": '), quoted, F.lit("}")))
        .when(k == 3, F.concat(F.lit('{"danger": "Y"} '), text))
        .when(k == 4, F.concat(F.lit("Some concern about soil in "), text))
        .when(k == 5, F.concat(F.lit("all calm in "), text))
        .when(k == 6, F.concat(F.lit('{"justification": '), quoted, F.lit("}")))
        .otherwise(text)
    )
    return d.select("doc_id", raw.alias("raw"))
