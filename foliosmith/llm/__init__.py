"""Training-data operators: ten corpus operators, each one DataFrame in, DataFrame out."""
