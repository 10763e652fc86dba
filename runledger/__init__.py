"""Training-job history and telemetry analytics on PySpark."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers travel with their tasks, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
