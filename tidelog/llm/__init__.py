"""Training-data operators: thirteen corpus operators, written as Spark jobs.

Nothing else in the package imports this subpackage.  Shared rules:

* inputs are DataFrames; columns are named by keyword where they may differ,
  extra columns are ignored unless an operator says that it passes them on;
* a null text counts as the empty text;
* intermediate tables are written to the folder in ``spark.checkpoint.dir``
  (see :mod:`tidelog.llm.shared`), so a lost executor only repeats tasks.
"""
