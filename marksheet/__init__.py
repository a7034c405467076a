"""marksheet: instruction-data preparation, answer grading and scoring as Spark jobs.

Every public function takes DataFrames/Columns and returns DataFrames/Columns; nothing
collects data-sized results to the driver.
"""

__version__ = "0.1.0"
