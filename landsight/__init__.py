"""landsight: environmental indicators and location-risk logs on Spark DataFrames.

Sub-packages:

* ``functions``  column expressions (code cleaning, number coercion, tile math,
  display text, model-reply parsing)
* ``sources``    readers and writers (indicator CSVs, boundaries, analysis log,
  tile inventory, fetch operator, test-table adapters)
* ``operators``  DataFrame -> DataFrame building blocks (boundary merge, years,
  statistics, insights, history, cache lookup)
* ``plans``      end-to-end plans (dashboard, tile preview, request workflow)
* ``streaming``  the request workflow as a Structured Streaming query
"""

__version__ = "0.1.0"


def _pickle_by_value() -> None:
    """Ship this package's functions and classes to Python workers by value.

    ``mapInPandas`` callables defined here (model calls, fetches) would
    otherwise be pickled by reference, and every executor would need the
    package installed; by value, only PySpark, pandas and pyarrow are needed
    there."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - PySpark is a hard dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_pickle_by_value()
