"""Ranking plans: treatments, engines and the registered queries."""
