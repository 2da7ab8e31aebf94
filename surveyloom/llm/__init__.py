"""Operators for building training corpora: scans, counts, classifiers, joins and packing over whole texts."""
