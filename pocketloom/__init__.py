"""pocketloom: a Spark-first engine for protein-ligand affinity data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors are sent along with the job, so that these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
