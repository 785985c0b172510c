"""Software-estate analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions they run by value, so executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
