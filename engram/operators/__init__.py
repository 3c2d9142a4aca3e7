"""DataFrame-to-DataFrame operators, one module for each capability family."""
