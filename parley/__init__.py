"""Spark-native construction, cleaning, deduplication and analysis of service-dialogue corpora."""

import sys

from pyspark import cloudpickle

# Functions run in tasks travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
