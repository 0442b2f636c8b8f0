"""Bindings of the driver's tables to the data model, and the queries over them."""
