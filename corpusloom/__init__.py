"""corpusloom: document-corpus analytics as Spark DataFrame operators.

Every operator is a function from DataFrames (or Columns) to DataFrames (or
Columns).  Nothing here starts jobs unless the function's docstring says so.
"""

__version__ = "0.1.0"
