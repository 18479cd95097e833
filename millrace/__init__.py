"""Message-flow analytics on Spark: integration operators expressed as DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions go to Python workers by value, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
