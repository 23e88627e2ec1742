"""Views over the driver's tables and the query catalog with its SQL."""
