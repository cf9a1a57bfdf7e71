"""Regrove: ecological field-survey analytics as PySpark DataFrame operators.

Every operator takes and returns DataFrames.  Nothing here collects data-sized
results to the driver; iterative fits bring back only model-sized moments.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Batch helpers travel to executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
