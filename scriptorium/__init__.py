"""Analytics over literary corpora, expressed as Spark plans."""
