"""Text operators for building training corpora: joins, dedup, sharding, classifiers, tokens, scoring and packing.

Nothing else in the library imports this subpackage."""
