"""claimlens: provider-integrity analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry this package's code with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
