"""Network-flow investigation analytics as Spark plans."""
