"""tessera: pixel-table preparation, repair and evaluation on Spark.

Every public operator is a pure function ``DataFrame -> DataFrame`` (or a
small tuple of DataFrames) built from Spark SQL expressions, joins,
aggregations and windows, so Catalyst plans the physical work.
"""

from tessera.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
