"""Training-data operators: scoring, mixing, deduplication, privacy, search, secrets, archives, toxicity.

Each module holds one operator on DataFrames; ``queries`` derives the registered
queries from them. Functions that run inside tasks are shipped by value, so
executors need no package path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
