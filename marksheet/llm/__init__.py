"""Training-data operators: one module per operator, registered through ``llm.catalog``.

Nothing else in the package imports this subpackage. Task functions travel to the executors by
value, so the executors need no copy of these modules.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
