"""Multi-site cohort analytics and federated risk models on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel with their tasks, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
