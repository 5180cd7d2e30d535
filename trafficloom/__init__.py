"""Gateway-traffic analytics on Spark: journal events in, exchanges, metrics and policies out."""
