"""flowgrid: origin-destination mobility analytics on PySpark."""
