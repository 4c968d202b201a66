"""Column functions on nucleotide sequences and on numbers."""
