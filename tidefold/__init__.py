"""State, stream and vector analytics as declarative Spark plans over an append-only operation log.

Functions that run on executors are pickled by value: executors need numpy, pandas and pyarrow, but no copy of this
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
