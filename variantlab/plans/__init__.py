"""The registered queries of the experiment operators and their SQL twins."""
