"""Governed retrieval as Spark jobs: request guard, exact vector top-k, field-level access,
second-person release gate and audit, each one a DataFrame operator."""

import sys

from pyspark import cloudpickle

# The few Arrow and pandas helpers travel inside their task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
