"""cadenza: layered event-warehouse operators for PySpark.

Every operator takes and returns DataFrames.  Unless its docstring says
otherwise it works unchanged on batch and on Structured Streaming input.
"""
