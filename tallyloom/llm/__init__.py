"""Operators for preparing training data; one module per operator, queries in ``catalog``."""

import sys

from pyspark import cloudpickle

# Workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
