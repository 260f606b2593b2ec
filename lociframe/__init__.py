"""Population-genomic analytics as Spark DataFrame operators.

Every public function takes DataFrames and returns DataFrames; nothing here
collects data to the driver.  See README.md for the module map.
"""

__version__ = "0.1.0"
