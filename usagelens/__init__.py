"""usagelens: governing the use of AI assistants with Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns); nothing
collects rows to the driver.
"""
