"""DataFrame operators. Functions take and return DataFrames; no hidden state."""
