"""The driver's tables as the domain's, and the registered queries."""
