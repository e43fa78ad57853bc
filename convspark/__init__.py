"""Multi-tenant customer-conversation analytics as PySpark DataFrame jobs."""
