"""Readers and writers: FASTA, TSV, .dot images, PNG, SVG, parameter files."""
