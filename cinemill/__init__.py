"""cinemill - PySpark engine for sampling and segmenting time-stamped streams.

Everything takes DataFrames and returns DataFrames; nothing is collected in library code unless a
docstring states the bound of what is collected.
"""

__version__ = "0.1.0"
