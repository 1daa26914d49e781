"""lettermill: message-corpus preparation, retrieval and evaluation on Spark."""

import sys

from pyspark import cloudpickle

# The small Python helpers travel with the tasks that call them, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
