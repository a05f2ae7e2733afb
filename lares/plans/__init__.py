"""The two registry layouts, end to end."""
