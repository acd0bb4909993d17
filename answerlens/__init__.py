"""AnswerLens: AI-search visibility analytics as Spark DataFrame jobs."""
