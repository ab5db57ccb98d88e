"""tabulon: spreadsheet-grade table operators expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
