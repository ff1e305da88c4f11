"""rosterlake: a PySpark-native registry analytics engine.

Everything is a function from DataFrames to DataFrames; Catalyst plans the work.
"""

__version__ = "0.1.0"
