"""Operators for preparing training corpora. Nothing outside this folder imports it.

Functions of this folder travel to the executors with the job, so the package needn't be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
