"""Training-data operators: one module each, all of them DataFrame in, DataFrame out."""
