"""tessera: document retrieval and data preparation as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
