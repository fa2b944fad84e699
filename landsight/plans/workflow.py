"""The risk workflow for a whole batch of coordinate requests.

For every request: look the key up in the log (J2) and fetch its tile (S9); for
keys not analysed yet, describe the image with a vision model (M1), assess
the description with a text model (M2), parse the reply natively (F22),
assemble log rows (K2) -- and return one result per request.

The models are injected: ``client_factory()`` returns an object with
``describe(image_path, config) -> str`` and ``assess(prompt, config) -> str``
(the raw reply), either of which may be a coroutine function.  A client that
also has ``batch_describe(image_paths, config)`` or ``batch_assess(prompts,
config)``, which return a list of texts (or an exception in a text's place), is
given lists.  A ``CallPolicy`` bounds the calls of a task: calls at once (a client
each; one by default), values in a batch, time-out, attempts and pauses.
Requests are deduplicated by key first, and ``model_parallelism`` sets how many
tasks call at once.  A call that keeps failing becomes an error text on its row
(that key is not logged and is retried on the next run) instead of failing
the job.

The model output is materialised once with ``DataFrame.checkpoint()`` into the
session's shared checkpoint folder: the result frame and the log append both
read it, so no model call runs twice, and a lost executor does not send the
batch back to the models.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_MODEL_CONFIG, ModelConfig
from ..functions.clean import strip_text
from ..functions.text import assessment_prompt
from ..functions.tiles import tile_file_name, tile_xyz
from ..functions.verdict import parse_verdict
from ..operators.cache import KEY, first_for_keys
from ..operators.calls import CallPolicy, Calls
from ..session import call_tasks, checkpoint_dir, default_parallelism

ClientFactory = Callable[[], object]


def _with_text_column(df: DataFrame, name: str, without: str) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name not in (name, name + "_error", without)]
    return T.StructType(fields + [T.StructField(name, T.StringType()), T.StructField(name + "_error", T.StringType())])


def _map_model(df: DataFrame, in_col: str, out_col: str, method: str, config: ModelConfig, client_factory: ClientFactory, policy: CallPolicy, keep: bool = True) -> DataFrame:
    """``out_col`` and its error: the answer of the client's ``method``, or of its
    ``batch_`` form, to each value of ``in_col``, which is dropped unless ``keep``."""
    schema = _with_text_column(df, out_col, without="" if keep else in_col)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = None
        try:
            for pdf in batches:
                # without input (an earlier step failed) there is no call and no new error
                given = [i for i, v in enumerate(pdf[in_col]) if not (v is None or (isinstance(v, float) and v != v))]
                outs, errs = [None] * len(pdf), [None] * len(pdf)

                def done(place, answer, error):
                    outs[given[place]] = answer
                    errs[given[place]] = None if error is None else f"{type(error).__name__}: {error}"

                if given:
                    calls = calls or _model_calls(method, config, client_factory, policy)
                    calls.run(pdf[in_col].iloc[given], done)
                pdf = pdf.assign(**{out_col: outs, out_col + "_error": errs})
                yield pdf[names]
        finally:
            if calls is not None:
                calls.__exit__()

    return df.mapInPandas(run, schema)


def _model_calls(method: str, config: ModelConfig, client_factory: ClientFactory, policy: CallPolicy) -> Calls:
    first = client_factory()
    batched = hasattr(first, "batch_" + method)
    name = "batch_" + method if batched else method
    ready = [first]  # the one that was looked at is used first

    def make():
        return ready.pop() if ready else client_factory()

    if inspect.iscoroutinefunction(getattr(first, name)):

        async def call(client, value):
            return await getattr(client, name)(value, config)
    else:

        def call(client, value):
            return getattr(client, name)(value, config)

    return Calls(make, call, policy, batched)


def describe_images(
    df: DataFrame, client_factory: ClientFactory, config: ModelConfig = DEFAULT_MODEL_CONFIG,
    path_col: str = "image_path", policy: CallPolicy = CallPolicy(),
) -> DataFrame:
    """M1: ``image_description`` (stripped) for each row's image."""
    out = _map_model(df, path_col, "image_description", "describe", config, client_factory, policy)
    return out.withColumn("image_description", strip_text("image_description"))


def assess_descriptions(
    df: DataFrame, client_factory: ClientFactory, config: ModelConfig = DEFAULT_MODEL_CONFIG,
    policy: CallPolicy = CallPolicy(),
) -> DataFrame:
    """M2 + F18 + F22: prompt built natively, raw reply from the text model,
    verdict parsed natively into ``danger`` and ``justification``."""
    prompted = df.withColumn("__prompt", assessment_prompt(config.text_prompt, F.col("image_description")))
    replied = _map_model(prompted, "__prompt", "raw_reply", "assess", config, client_factory, policy, keep=False)
    v = parse_verdict("raw_reply")
    return replied.withColumns({"danger": v["danger"], "justification": v["justification"]})


def log_rows(analysed: DataFrame, config: ModelConfig = DEFAULT_MODEL_CONFIG, clock=None) -> DataFrame:
    """K2 + F14: log rows in the fixed field order; the timestamp is the UTC
    time of the batch (``clock`` -- a Column -- overrides it, e.g. in tests)."""
    ts = clock if clock is not None else F.current_timestamp()
    return analysed.select(
        ts.alias("timestamp"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        F.col("zoom").cast("int").alias("zoom"),
        "image_description",
        F.lit(config.image_prompt.strip()).alias("image_prompt"),
        F.lit(config.image_model).alias("image_model"),
        F.col("justification").alias("text_description"),
        F.lit(config.text_prompt.strip()).alias("text_prompt"),
        F.lit(config.text_model).alias("text_model"),
        "danger",
    )


def analyse_keys(
    keys: DataFrame,
    client_factory: ClientFactory,
    image_root: str,
    config: ModelConfig = DEFAULT_MODEL_CONFIG,
    model_parallelism: int | None = None,
    policy: CallPolicy = CallPolicy(),
) -> DataFrame:
    """Tile, describe and assess every distinct key (each model called at
    most once per key, further attempts apart)."""
    work = keys.withColumn("tile_file", tile_file_name(tile_xyz("latitude", "longitude", "zoom")))
    work = work.withColumn("image_path", F.concat(F.lit(image_root.rstrip("/") + "/"), F.col("tile_file")))
    # Each row is an expensive external call but only a few bytes, so AQE would
    # coalesce the key shuffle into very few tasks.  A round-robin repartition
    # to a set number is kept as given (a hash repartition on the keys would be
    # dropped as redundant after the distinct).
    spark = keys.sparkSession
    work = work.repartition(model_parallelism or default_parallelism(spark) or int(spark.conf.get("spark.sql.shuffle.partitions")))
    # One linear pass: a row whose description failed has no prompt, so the
    # text model skips it -- each model is called at most once per key.
    return assess_descriptions(describe_images(work, client_factory, config, policy=policy), client_factory, config, policy)


def whole_key(df: DataFrame):
    """All three key columns are given (a NaN coordinate is missing too)."""
    ok = F.lit(True)
    for c in KEY:
        ok = ok & F.col(c).isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            ok = ok & ~F.isnan(c)
    return ok


def fetch_tiles(keys: DataFrame, image_root: str, fetch, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """S9 for the workflow: fetch the tiles of ``keys`` that are not landed yet;
    returns the ``tile_file`` names that are there afterwards."""
    from ..operators.cache import tile_work_list
    from ..sources.fetch import run_fetch, tile_fetch_plan
    from ..sources.tiles import read_tile_inventory

    spark = keys.sparkSession
    landed = read_tile_inventory(spark, image_root).select("file_name")
    results = run_fetch(tile_fetch_plan(tile_work_list(keys, landed), image_root), fetch, policy=policy).checkpoint(eager=True)
    new = results.where(F.col("error").isNull()).select(F.regexp_extract("target_path", r"[^/]+$", 0).alias("file_name"))
    return landed.unionByName(new).select(F.col("file_name").alias("tile_file")).distinct()


def process_requests(
    requests: DataFrame,
    log: DataFrame,
    client_factory: ClientFactory,
    image_root: str,
    config: ModelConfig = DEFAULT_MODEL_CONFIG,
    clock=None,
    model_parallelism: int | None = None,
    fetch=None,
    first: DataFrame | None = None,
    policy: CallPolicy = CallPolicy(),
):
    """Returns ``(results, new_log_rows)``.

    ``first`` gives the first stored results by key (the key columns and the
    payload, one row a key); with it the log is not read and may be None.

    ``results``: every request with ``source`` (``cache`` or ``model``, NULL when
    the model failed), ``image_description``, ``danger``, ``justification``,
    ``error``, ``tile_file``, ``image_path`` and ``tile_fetched``.  A request
    without a whole key has an error and reaches no model and no log.
    ``new_log_rows``: the rows to append (K1) -- successful model results only.
    With ``fetch`` (``url -> bytes``) the tiles of all keys, hits and misses,
    are fetched first; without it ``tile_fetched`` is NULL.
    """
    from ..sources.store import materialize

    keys = requests.where(whole_key(requests)).select(*KEY).distinct()
    payload = ("image_description", "danger", "text_description")
    first = first_for_keys(log, keys, payload) if first is None else first.select(*KEY, *payload)
    # the lookup is written once: hits, misses and results derive from it
    looked = materialize(keys.join(first.withColumn("hit", F.lit(True)), KEY, "left"), "lookup")
    checkpoint_dir(requests.sparkSession)
    tiles = fetch_tiles(looked, image_root, fetch, policy) if fetch is not None else None
    misses = looked.where("hit IS NULL").select(*KEY)
    model_parallelism = model_parallelism or call_tasks(requests.sparkSession)
    analysed = analyse_keys(misses, client_factory, image_root, config, model_parallelism, policy).checkpoint(eager=True)
    good = analysed.where(F.col("danger").isNotNull() & F.col("raw_reply_error").isNull())
    new_rows = log_rows(good, config, clock)

    from_cache = looked.where("hit").select(
        *KEY, F.lit("cache").alias("source"), "image_description", "danger",
        F.col("text_description").alias("justification"), F.lit(None).cast("string").alias("error"),
    )
    from_model = analysed.select(
        *KEY,
        F.when(
            F.col("danger").isNotNull() & F.col("image_description_error").isNull()
            & F.col("raw_reply_error").isNull(),
            F.lit("model"),
        ).alias("source"),
        "image_description", "danger", "justification",
        F.coalesce("image_description_error", "raw_reply_error").alias("error"),
    )
    per_key = from_cache.unionByName(from_model)
    per_key = per_key.withColumn("tile_file", tile_file_name(tile_xyz("latitude", "longitude", "zoom")))
    if tiles is None:
        per_key = per_key.withColumn("tile_fetched", F.lit(None).cast("boolean"))
    else:
        per_key = per_key.join(tiles.withColumn("tile_fetched", F.lit(True)), "tile_file", "left")
        per_key = per_key.withColumn("tile_fetched", F.coalesce("tile_fetched", F.lit(False)))
    per_key = per_key.withColumn("image_path", F.concat(F.lit(image_root.rstrip("/") + "/"), "tile_file"))
    results = requests.join(per_key, KEY, "left")
    incomplete = F.when(~whole_key(requests), F.lit("coordinates or zoom missing"))
    return results.withColumn("error", F.coalesce("error", incomplete)), new_rows


def run_requests(requests: DataFrame, log_path: str, client_factory: ClientFactory, image_root: str,
                 config: ModelConfig = DEFAULT_MODEL_CONFIG, model_parallelism: int | None = None,
                 fetch=None, first_results: str | None = None, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """W1 + K1: process a batch against the stored log and append the new rows.

    With ``first_results``, the path of a key table over the log, only the
    buckets of the requested keys are read instead of the log, and the new rows
    are merged into it after the append."""
    from ..sources.first_results import merge_first_results, read_first_results
    from ..sources.log import append_log, read_log

    spark = requests.sparkSession
    log = first = None
    if first_results is None:
        log = read_log(spark, log_path, with_id=True)
    else:
        first = read_first_results(spark, first_results, requests)
    results, new_rows = process_requests(
        requests, log, client_factory, image_root, config, model_parallelism=model_parallelism, fetch=fetch, first=first, policy=policy
    )
    if first_results is not None:
        new_rows = new_rows.withColumn("id", F.unix_micros("timestamp")).checkpoint(eager=True)
        append_log(new_rows, log_path)
        merge_first_results(new_rows, first_results)
    else:
        append_log(new_rows, log_path)
    return results


class StubModelClient:
    """A deterministic stand-in for the two models (tests and the registered
    query).  The description names the tile file and the size of its image,
    which it reads; the reply is a JSON verdict for images with an even number
    of bytes and plain text otherwise."""

    def describe(self, image_path: str, config: ModelConfig) -> str:
        from ..sources.fetch import file_system

        system, where = file_system(image_path)
        with system.open_input_stream(where) as image:
            size = len(image.read())
        return f"tile {image_path.rsplit('/', 1)[-1]} of {size} bytes\n"

    def assess(self, prompt: str, config: ModelConfig) -> str:
        name, _, size = prompt.rsplit("tile ", 1)[-1].strip().removesuffix(" bytes").partition(" of ")
        if int(size) % 2 == 0:
            return '```json\n{"danger": "Y", "justification": "eroded banks near ' + name + '"}\n```'
        return "no visible change near " + name


class BatchStubModelClient(StubModelClient):
    """The stub with batch calls, as a busy server answers them: of a batch's
    values, every third finds the server busy at its first attempt."""

    def __init__(self):
        self.refused = set()

    def _each(self, values, config: ModelConfig, one) -> list:
        out = []
        for k, value in enumerate(values):
            if k % 3 == 0 and len(values) > 1 and value not in self.refused:
                self.refused.add(value)
                out.append(ConnectionError("busy"))
                continue
            self.refused.discard(value)
            try:
                out.append(one(value, config))
            except Exception as e:  # noqa: BLE001 -- an answer of its own
                out.append(e)
        return out

    def batch_describe(self, image_paths: list[str], config: ModelConfig) -> list:
        return self._each(image_paths, config, self.describe)

    def batch_assess(self, prompts: list[str], config: ModelConfig) -> list:
        return self._each(prompts, config, self.assess)
