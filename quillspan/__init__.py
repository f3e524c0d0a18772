"""quillspan: retrieval and document analytics as Spark DataFrame operators."""
