"""Climate-hazard risk analytics as Spark jobs: every operator is DataFrame -> DataFrame."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python kernels travel inside their tasks, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
