"""quillguard: content inspection and findings analytics as Spark jobs."""
