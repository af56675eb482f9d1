"""spanshield: text protection and usage analytics as Spark DataFrame jobs.

Every public operator is a pure ``DataFrame -> DataFrame`` (or ``Column -> Column``) function;
Catalyst plans and runs the work.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value in Python tasks (folds, stream state), so workers
    need neither an installed package nor ``--py-files``."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files instead
        pass


_ship_by_value()
