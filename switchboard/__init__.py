"""Call-conversation analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# the few functions that run inside tasks travel with them, so that executors
# do not need this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
