"""Plans: the composite operators and the catalogue of registered queries."""
