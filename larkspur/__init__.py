"""larkspur: document queries, relationships and mutations as Spark plans."""
