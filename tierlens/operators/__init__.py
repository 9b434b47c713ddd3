"""DataFrame operators: reviews to spans, spans to cubes, cubes to answers, labels to scores."""
