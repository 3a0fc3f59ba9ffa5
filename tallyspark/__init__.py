"""tallyspark: periodic-investment backtests and exact document retrieval on Spark.

Every operator is a pure function ``DataFrame -> DataFrame`` built from Spark's
own operators (aggregations, windows, joins).  Python runs inside tasks only in
two Arrow-native kernels in ``operators.vectors`` (bucket counting for the
hashed embedding, and the dense top-k block kernel).
"""

import sys as _sys

# Functions of this package that run inside Python workers (Arrow UDFs,
# mapInArrow / applyInArrow kernels) are pickled by value, so executors need no installed
# copy of the package and the driver may run from any working directory.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

from tallyspark.session import get_session, checkpoint_dir  # noqa: E402

__all__ = ["get_session", "checkpoint_dir"]
