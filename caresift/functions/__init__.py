"""Column functions: text, rules, weights, answers."""
