"""ledgerflow: a PySpark-native toolkit for scheduled reporting pipelines."""

import sys

from pyspark import cloudpickle

#: Functions that go to Python workers travel by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
