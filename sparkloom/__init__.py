"""sparkloom: analytic operators written natively for Apache Spark.

Every operator takes and returns a ``DataFrame`` (or a ``Column``), stays lazy
wherever the result allows it, and leaves the physical strategy to Catalyst.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with their task, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
