"""Operators that prepare text corpora for training language models, each by one named method."""
