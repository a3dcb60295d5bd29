"""Table preparation on Spark: load, profile, clean, look up, derive, aggregate, validate, export.

Every operator is a function from DataFrame to DataFrame. Where a result depends on row
position the function takes ``order_by``, the columns that put the rows in a total order.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
