"""glossa: a Spark-native engine for lexical and document corpora."""
