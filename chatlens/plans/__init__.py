"""Reports: each a function from ChatTables (+ parameters) to a DataFrame."""
