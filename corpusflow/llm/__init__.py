"""Training-data operators: ten distributed operators over documents, pages and labels."""
