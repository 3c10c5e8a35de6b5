"""Network-forensics analytics as Spark jobs."""
