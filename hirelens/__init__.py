"""Job-market analytics and text-corpus operators on Spark.

Functions of this package that run inside Python workers are shipped by value,
so executors need no copy of the package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
