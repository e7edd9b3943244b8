"""Daily-demand analytics for many series at once, as Spark DataFrame operators.

Every operator takes and returns a lazy DataFrame keyed by ``(zone, period)``: one
row per series and calendar day.  Nothing is positional and nothing is collected.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The small matrix helpers that run inside tasks travel with the task, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
