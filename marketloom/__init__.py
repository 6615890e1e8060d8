"""Market features, news sentiment and portfolio evaluation as Spark jobs.

Every public function takes DataFrames (or Columns) and returns a lazy
DataFrame (or Column); only the writers and the streaming sinks run a job.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the job, so executors need
# no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
