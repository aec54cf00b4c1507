"""Analytics over learning and question-bank data, as Spark plans.

Functions shipped to executors are pickled by value, so executors need not have
the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
