"""lectern: grounded retrieval, quizzes and evaluation over page-structured text, as Spark plans."""
