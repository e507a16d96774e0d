"""Column functions: money in whole cents, guardrails, demand, text."""
