"""Plans that one expression cannot say, and the catalogue of queries."""
