"""gaugeline: evaluate, rank and route prompting strategies as Spark jobs.

Every public function takes and returns DataFrames or Columns; nothing here
loops over rows on the driver.
"""

__version__ = "0.1.0"
