"""Training-data operators: near duplicates, filters, packing, archives, secrets, classifiers."""
