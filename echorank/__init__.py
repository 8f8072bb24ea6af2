"""Content-similarity search over feature tables, as Spark jobs.

DataFrames in, DataFrames out. Sub-packages:

``sources``    feature text, CSV, ARFF, Parquet and WAV readers
``sinks``      writers for the same formats, audit and manifest tables
``functions``  column expressions and Arrow kernels
``operators``  scaling, statistics, joins, beat models, medians, ranking order
``plans``      whole queries: rankings, filter-and-refine, feature extraction
``streaming``  append-only-new as a Structured Streaming job
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Kernels travel to executors by value: no package has to be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
