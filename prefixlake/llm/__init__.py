"""Training-data operators: ten corpus operations used before and beside language-model training."""
