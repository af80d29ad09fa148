"""Training-data operators; their registered queries are in ``queries``.

Functions of this package that run in tasks are sent to the executors by
value, so a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
