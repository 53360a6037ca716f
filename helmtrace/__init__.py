"""Vessel-tracking analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a lazy DataFrame; the only actions the
library starts on its own are the checks of small control tables (zones, date lists)
and the sinks.
"""

__version__ = "0.1.0"
