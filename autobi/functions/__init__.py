"""Column functions: parsing, binning, formatting."""
