"""Reading lines and writing results."""
