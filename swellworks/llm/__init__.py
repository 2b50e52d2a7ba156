"""Training-data operators on whole corpora.  Nothing outside this subpackage imports it."""
