"""quire: document analytics as Spark plans."""
