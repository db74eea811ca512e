"""codeloom: a Spark-native engine for analytics over indexes of source code and content."""
