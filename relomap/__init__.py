"""relomap: a Spark-native engine for finding relocated content in document diffs, with the text operators of a
training-data pipeline beside it (subpackage ``llm``)."""
