"""Demand forecasting and audit over many series at once, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the small task-side helpers with the job, so that executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
