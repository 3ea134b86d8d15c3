"""Analytics over large collections of documents, as Spark jobs."""
