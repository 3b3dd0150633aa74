"""beatloom: catalog search, script analytics and data preparation on Spark.

Every public function maps DataFrames to DataFrames; nothing runs until the
caller acts on the result.
"""

__version__ = "0.1.0"
