"""tessera: source-corpus analytics and training-data operators on Spark."""
