"""Training-data operators: formatting, filtering, deduplication, decontamination and packing of text corpora."""
