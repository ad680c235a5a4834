"""riskmap: risk targeting and segmentation as Spark DataFrame operators."""

__version__ = "0.1.0"


def _pickle_by_value() -> None:
    """Ship this package's functions inside task closures.

    The pandas UDFs and ``mapInPandas`` functions reference module-level
    helpers; registering the package with PySpark's cloudpickle serializes
    them by value, so executors need not have the package installed.
    """
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 -- older cloudpickle: fall back to --py-files
        pass


_pickle_by_value()
