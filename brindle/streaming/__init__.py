"""Extensions beyond the builder: windowed aggregation over streams."""
