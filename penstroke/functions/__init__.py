"""Column functions: cleaning, segmentation, lexicons and counts."""
