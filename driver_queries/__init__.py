"""The registered queries: each one a Spark callable and, where SQL can say the
same over the whole tables, its SQL twin."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
