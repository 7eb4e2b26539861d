"""The operators of a flow, one mix-in per group."""
