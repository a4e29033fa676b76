"""Panel analytics on Spark: entity x indicator x date observations as DataFrames."""

import sys

from pyspark import cloudpickle

# Model functions travel to the workers as code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
