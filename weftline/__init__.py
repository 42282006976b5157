"""weftline: weekly index analytics and corpus preparation on Spark."""
