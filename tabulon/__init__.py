"""tabulon: whole-table profiling, cleaning, feature and modelling operators on Spark DataFrames.

Every operator takes a DataFrame and returns a DataFrame (plus, where it
records what it did, a small result DataFrame or dataclass).  Statistics are
computed on the executors; only results bounded by the number of columns,
histogram buckets or checked category counts reach the driver.
"""

__version__ = "0.1.0"
