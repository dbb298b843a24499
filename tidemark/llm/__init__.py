"""Operators for large training-text pipelines. Nothing else in ``tidemark`` imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this subpackage travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
