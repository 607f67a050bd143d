"""Operators of the payment-movement library."""
