"""Functions of the payment-movement library."""
