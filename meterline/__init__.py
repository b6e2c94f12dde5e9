"""meterline: usage-log analytics as PySpark DataFrame operators.

Every operator takes and returns DataFrames built from built-in Spark
expressions, so Catalyst plans the work and Tungsten runs it.  Nothing in
the batch path uses a Python UDF.  The current time is always an argument
(``as_of``) so results are repeatable.
"""

from meterline.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
