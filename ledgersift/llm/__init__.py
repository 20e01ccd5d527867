"""Training-data operators: each module is one operator, `queries` and `oracles` register them."""
