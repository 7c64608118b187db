"""tastegrid: rating analytics and recommendations as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run inside Python tasks travel with the job, so that
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
