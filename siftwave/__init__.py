"""siftwave: windowed sequence sampling on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# executors need no copy of the package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
