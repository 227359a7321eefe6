"""Column functions over sequences, scores, sizes and labels."""
