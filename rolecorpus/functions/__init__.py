"""Column functions: text, addresses, places, salaries and dates."""
