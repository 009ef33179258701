"""sitelens: website corpus analytics as Spark DataFrame operators."""


def _ship_by_value() -> None:
    """Pickle this package's Python functions (UDF bodies, ``mapInPandas`` and
    state functions) by value, so executors need no installed copy of it."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
