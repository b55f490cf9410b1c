"""Training-data operators: packing, search, token files, decontamination, dedup, scoring, formatting, WARC.

Nothing else in the library imports this subpackage. Its functions travel to the Python
workers by value, so a cluster needs no copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
