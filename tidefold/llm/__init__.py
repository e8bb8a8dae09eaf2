"""Training-data operators: deduplication, fingerprints, mixing, search, packing, quality, PII and WARC.

Nothing else in the library imports this package. Functions that run on executors are pickled by value, so
executors need numpy, pyarrow and xxhash but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
