"""sightline: perception and corpus analytics expressed as Spark plans."""
import sys

from pyspark import cloudpickle

# Functions of this package travel by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
