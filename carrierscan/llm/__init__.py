"""Training-data operators: search, archives, filters, scoring, packing, joins and mixing."""
