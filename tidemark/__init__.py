"""Economic time-series analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames in the long shape
``(series, d, v)``.  A series holds at most one row per calendar date once it
has passed :func:`tidemark.operators.clean.one_row_per_date`, so windows and
grouped maps keyed by series are bounded by the calendar, never by the volume
of raw observations.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: no install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
