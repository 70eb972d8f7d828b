"""The search façade and the registered queries."""
