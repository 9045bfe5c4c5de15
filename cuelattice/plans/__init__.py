"""Sequential programs that run as grouped functions."""
