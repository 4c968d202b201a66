"""Readers and writers of genes, sequences, motif tables and model specifications."""
