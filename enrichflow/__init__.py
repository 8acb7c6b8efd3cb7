"""Discovery, enrichment and reporting of record collections as Spark DataFrame operators."""
import sys

from pyspark import cloudpickle

# Python helpers travel to executors inside the task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
