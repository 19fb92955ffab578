"""Reading and writing problems, models and predictions."""
