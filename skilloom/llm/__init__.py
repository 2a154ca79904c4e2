"""Training-data operators: one module per operator, each with its query; ``registry`` lists the queries."""
