"""quire: document-structuring analytics as set-oriented Spark plans."""
