"""Column functions with spreadsheet edge rules; all run JVM-side."""
