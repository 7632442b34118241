"""siftline: hybrid retrieval over mixed corpora, written as Spark DataFrame plans."""
