"""Training-data operators over whole corpora of documents, one module each."""
