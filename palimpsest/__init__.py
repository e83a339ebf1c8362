"""Personal-data detection, anonymisation and scoring as Spark plans."""

__version__ = "0.1.0"
