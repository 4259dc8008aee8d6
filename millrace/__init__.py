"""millrace: lead, content and corpus analytics as Spark DataFrame operators."""
