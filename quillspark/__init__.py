"""quillspark: retrieval-style text analytics as Spark DataFrame plans."""
