"""vitrine: catalogue records to a searchable vector collection, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Worker-side helpers travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
