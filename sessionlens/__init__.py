"""sessionlens: analytics over AI-agent traffic traces, written as Spark DataFrame jobs."""
