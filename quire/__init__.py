"""quire: a PySpark-native document retrieval and QA-dataset engine.

Every public operator is a function ``DataFrame -> DataFrame`` (or a Column
builder) expressed with Spark SQL expressions, so Catalyst plans, prunes and
pushes down the whole corpus job; Python only runs inside Arrow batches where a
caller plugs in a model or where a vectorised NumPy kernel beats the
interpreted higher-order functions (the kNN distance block).
"""

__version__ = "0.1.0"

# Ship this package's functions to Python workers by value: Arrow kernels and
# plug-in wrappers defined here then run on executors that do not have the
# package on their path (the driver may import it from a checkout).
try:  # pragma: no cover - depends on the PySpark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - fall back to by-reference pickling
    pass
