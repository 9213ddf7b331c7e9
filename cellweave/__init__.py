"""cellweave: barcode/UMI analytics and record-scale data processing on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to executors travel with their code, so nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
