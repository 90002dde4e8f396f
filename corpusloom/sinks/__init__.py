"""Writers: svmlight, vocabulary, text, ids, topics and the Parquet dataset."""
