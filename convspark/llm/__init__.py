"""Training-data operators: filters, scans, deduplication, decontamination, mixing and archives."""
