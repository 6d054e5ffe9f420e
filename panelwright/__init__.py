"""Panel statistics on Spark: one row per entity and date, DataFrames in and out."""

import sys

from pyspark import cloudpickle

# The few Python tasks (moment partials, series fits) travel by value, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
