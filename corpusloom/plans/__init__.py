"""Whole-corpus preparation: from raw documents to splits, vocabulary and sparse rows."""
