"""Exact-duplicate file-inventory analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them: no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
