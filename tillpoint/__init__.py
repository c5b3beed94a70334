"""tillpoint — point-of-sale analytics for many outlets, expressed as Spark plans.

Every public operator takes DataFrames (and small parameters) and returns a
DataFrame; nothing is collected to the driver except bounded verdict tables.
"""

__version__ = "0.1.0"
