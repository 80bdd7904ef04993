"""pricelens: property-listing analytics as PySpark DataFrame transforms."""
