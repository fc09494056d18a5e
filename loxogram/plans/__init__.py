"""Registered queries, their SQL oracles, and the experiment harness."""
