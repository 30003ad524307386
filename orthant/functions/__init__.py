"""Column expressions: distances, dominance, boxes, partition hashes."""
