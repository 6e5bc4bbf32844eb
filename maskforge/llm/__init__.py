"""Training-data operators (the numbered queries ``opN_*`` and the corpus pipeline)."""
