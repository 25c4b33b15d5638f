"""Column functions: text, prompts and the fixed values behind them."""
