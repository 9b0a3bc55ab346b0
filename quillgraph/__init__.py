"""Evidence retrieval and question-answering evaluation as Spark jobs over all questions at once."""
