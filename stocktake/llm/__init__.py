"""Training-data operators: one module for each operator, one for their registered queries."""
