"""quillstack: a Spark-first engine for annotated documents and text corpora."""
