"""Extensions on unbounded tables."""
