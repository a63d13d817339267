"""End-to-end pipelines and the queries registered for the driver."""
