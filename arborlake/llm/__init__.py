"""Jobs for building training corpora from text: archives, filters, copies, contamination, personal data, tokens."""
