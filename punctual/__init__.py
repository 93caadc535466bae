"""Delivery-performance (On-Time In-Full) analytics as Spark DataFrame jobs."""
