"""Feature preparation on Spark: typed operators, a fit planner, and the tables they need.

Functions of this package travel to the executors with the job, so it needn't be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
