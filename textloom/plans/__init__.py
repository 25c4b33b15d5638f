"""Studies as plans, and the catalogue of driver queries."""
