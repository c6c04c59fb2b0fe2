"""marrowgrid: flow-cytometry cohort analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# helpers called inside tasks travel with them, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
