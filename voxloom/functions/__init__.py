"""voxloom subpackage."""
