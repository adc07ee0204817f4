"""provlake: composition of provenance-bearing observations on PySpark."""
