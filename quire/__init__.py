"""quire: text-corpus analytics on Spark."""
