"""Booking analytics and cancellation risk as Spark DataFrame operators."""
