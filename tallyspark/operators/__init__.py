"""The stages of the invoice pipeline as expressions over nested columns."""
