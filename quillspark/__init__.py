"""quillspark: analytics over large collections of documents, written for Spark."""
