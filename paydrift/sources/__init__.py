"""Sources of the payment-movement library."""
