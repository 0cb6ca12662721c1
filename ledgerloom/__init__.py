"""Corporate-disclosure analytics on Spark: a property graph, a fact table, and the queries over them."""
