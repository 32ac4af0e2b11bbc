"""Booking analytics and time-slot recommendation on PySpark."""

__version__ = "0.1.0"
