"""lumenmill subpackage."""
