"""flowgrid subpackage."""
