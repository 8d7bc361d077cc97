"""Inputs: canonical bars from market tables or from trades, pairs of bars, liquidity screens."""
