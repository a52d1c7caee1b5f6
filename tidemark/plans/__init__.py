"""Indicators, scores, backtests and portfolios."""
