"""lexiloom: interval, signal and text analytics over large corpora, written for Spark."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
