"""Tidemark: versioned trade-event analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
