"""Column expressions. Every function returns a ``pyspark.sql.Column`` built
from ``pyspark.sql.functions`` only (no Python UDF), so they stay inside
whole-stage codegen."""

from comparo.functions.text import *  # noqa: F401,F403
from comparo.functions.dates import *  # noqa: F401,F403
from comparo.functions.numeric import *  # noqa: F401,F403
