"""tessera: text and tabular feature engineering expressed as Spark DataFrame plans.

Modules:
  functions/  Column -> Column helpers (cleaning, tokens, per-row statistics)
  operators/  DataFrame -> DataFrame jobs (encoders, groupings, lags, corpus
              statistics, sequences, metrics, folds, ensembles, models)
  sources/    readers and writers (parquet tables, CSV lexicons, word vectors,
              prediction files, submissions, run tables)
  plans/      composed feature jobs and the query catalog
  streaming/  the per-row cleaning chain on a streaming DataFrame
"""

__version__ = "0.1.0"

try:  # ship our helpers by value to Python workers (pandas UDFs) without PYTHONPATH tweaks
    from pyspark import cloudpickle as _cp
    import sys as _sys

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
