"""Column expressions.

Functions of this package that run in Python workers travel with the plan, by value: workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
