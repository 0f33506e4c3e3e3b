"""Daily-bar signal analytics as Spark plans: indicators, scans, ranking, backtests and positions."""
