"""quillon: Spark-native analysis and curation of text corpora and layout documents."""
