"""Reading documents in, writing results out."""
