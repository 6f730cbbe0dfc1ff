"""Training-data operators: ten stand-alone jobs over documents, pages and embeddings."""
