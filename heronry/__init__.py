"""Corpus curation on Spark: manifests, gates, text, lexicon, sampling, quality control and signal features."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions that run there travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
